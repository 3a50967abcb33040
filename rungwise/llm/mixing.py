"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output. A document's mean repetition
rate is that share times the output size over the rows of its source; its
count is the inverse of the Poisson distribution of that mean at a uniform
number hashed from the seed and its id. Documents are exploded by their count
and dealt out globally in the order of another hash.

Target weights default to ``rows ** TEMPERATURE`` of each source, which lifts
small sources; ``weights`` names others (a source not named there weighs 0).

Defined results: rows with a null source form a source of their own (named
None in ``weights``); a null text is carried along; rows that repeat an id get
the same count; a null id hashes as the word "null"; an empty table gives an
empty result; input columns named mix_copy or mix_key are replaced; other
columns may have any name, with dots too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import documents, materialize

TEMPERATURE = 0.7
SEED = 17
#: Up to so many numbers in the tables of all sources (16 MB) they are broadcast; beyond, they are joined by shuffle.
BROADCAST_NUMBERS = 2_000_000
#: Rates above it are not summed from exp(-rate).
LARGE = 700.0


def uniform(seed: int, salt: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from an md5 of the seed, a salt and the parts."""
    key = F.concat_ws(":", F.lit(f"{seed}:{salt}"), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> tuple[Column, Column]:
    """(low, cumulative probabilities of low, low + 1, ...), so far that the rest is below 2^-52.

    exp(-rate) leaves the doubles at a rate of 745. Above LARGE the terms start as far below the rate as they end
    above it, from 1, and are divided by their sum; counts below ``low``, of less than 2^-52 together, have 0.
    """
    past = 12 * F.sqrt(rate) + 30
    low = F.when(rate > LARGE, F.floor(rate - past)).otherwise(0).cast("int")
    first = F.when(rate > LARGE, 1.0).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    def finish(acc):
        total = F.when(rate > LARGE, acc["c"]).otherwise(1.0)
        return F.transform(acc["all"], lambda c: c / total)

    return low, F.aggregate(F.sequence(low + 1, F.ceil(rate + past).cast("int")), start, step, finish)


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ..."""
    low, table = poisson_table(rate)
    return F.concat(F.array_repeat(F.lit(0.0), low), table)


def rates(docs: DataFrame, weights: dict | None, size: float, temperature: float) -> DataFrame:
    """Per source: mean repetition rate and the cumulative probabilities of counts."""
    counts = docs.groupBy(F.col("source").alias("r_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, w double")
        weighted = counts.join(named, F.col("r_source").eqNullSafe(F.col("w_source")), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    weighted = materialize(weighted, "mix-sources")
    sum_w, sum_n = weighted.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    rate = F.col("w") / F.lit(sum_w) * F.lit(sum_n) * size / F.col("n") if sum_w > 0 else F.lit(0.0)
    low, table = poisson_table(F.col("rate"))
    return materialize(weighted.select("r_source", rate.alias("rate")).select("r_source", "rate", low.alias("low"), table.alias("cdf")), "mix-rates")


def mix(docs: DataFrame, weights: dict | None = None, size: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The input's columns, each row as often as its count, with mix_copy (from 1) and mix_key."""
    taken = ("mix_copy", "mix_key")
    names = [n for n in docs.columns if n.lower() not in taken]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    by_source = rates(docs, weights, size, temperature)
    if by_source.agg(F.coalesce(F.sum(F.size("cdf")), F.lit(0))).first()[0] <= BROADCAST_NUMBERS:
        by_source = F.broadcast(by_source)
    u = uniform(seed, "count", F.col("id"))
    copies = F.col("low") + F.size(F.filter("cdf", lambda c: c <= u))
    counted = rows.join(by_source, F.col("of").eqNullSafe(F.col("r_source"))).withColumn("copies", copies.cast("int"))
    exploded = counted.filter("copies > 0").select("id", "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))
    keyed = exploded.withColumn("mix_key", uniform(seed, "order", F.col("id"), F.col("mix_copy")))
    return keyed.select("row.*", "mix_copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = f"""
WITH n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {TEMPERATURE}) / sum(pow(n, {TEMPERATURE})) OVER () * sum(n) OVER () / n AS rate FROM n),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
      FROM r, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 31) AS BIGINT))) AS k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT *, CAST(('0x' || substr(md5('{SEED}:count:' || doc_id), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
d AS (SELECT u.doc_id, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars, count(*) AS copies
      FROM u JOIN c ON u.source = c.source AND c.c <= u.u GROUP BY u.doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(mix_copy AS INTEGER) AS mix_copy,
       CAST(('0x' || substr(md5('{SEED}:order:' || doc_id || ':' || mix_copy), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS mix_key
FROM d, LATERAL (SELECT unnest(range(1, copies + 1)) AS mix_copy)
"""
