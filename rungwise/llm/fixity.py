"""Merkle fixity audit of WARC records held in replicas.

A page becomes the bytes of a WARC response record. Records are laid out in
files of ``FILE_RECORDS`` consecutive ids, so every record has an ordered
offset range. A leaf hashes the record's bytes together with its range;
``FANOUT`` consecutive nodes hash to their parent, up to one root per file and
then over files in the same way. Replicas are audited from the roots down:
only children of nodes that differ are read on, and the leaves that differ
locate the corruption. Nodes without a counterpart (records one replica lacks)
count as different.

Defined results: null url or html count as empty; rows that repeat an id are
one record, whose hash is made of their number and the sums of their hashes, in
any order; rows with a null id are such a record in a file of its own, before
all others, and come out with null page_id and file; empty tables give an empty
result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.llm._shared import materialize, pick

FILE_RECORDS = 1000
FANOUT = 16
#: Stands for a null id; first place of a file, and a file that no id comes near.
NO_ID = -(1 << 53)


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC response record; its block is the page."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """file, slot, record_start, record_length and digest of each record id."""
    rows = pick(pages, "page_id", "url", "html")
    raw = record_bytes(F.col("url").cast("string"), F.col("html").cast("string"))
    each = rows.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.sha2(raw, 256).alias("d"), F.length(raw).cast("long").alias("n"))
    # repeated rows in bounded memory: the four quarters of their hashes are summed as whole numbers
    quarters = [F.sum(F.conv(F.substring("d", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"q{k}") for k in range(4)]
    one = each.groupBy("page_id").agg(F.count(F.lit(1)).alias("rows"), F.min("d").alias("d"), *quarters, F.sum("n").alias("record_length"))
    digest = F.when(F.col("rows") == 1, F.col("d")).otherwise(F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "q0", "q1", "q2", "q3").cast("binary"), 256))
    file, slot = F.floor(F.col("page_id") / FILE_RECORDS), F.pmod("page_id", F.lit(FILE_RECORDS)).cast("int")
    laid = one.select(file.alias("file"), slot.alias("slot"), "page_id", "record_length", digest.alias("digest"))
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # FILE_RECORDS rows at most
    return laid.withColumn("record_start", F.coalesce(F.sum("record_length").over(before), F.lit(0).cast("long")))


def leaves(laid: DataFrame) -> DataFrame:
    text = F.concat_ws(":", "digest", F.col("record_start").cast("string"), F.col("record_length").cast("string"))
    return laid.select("file", F.col("slot").cast("long").alias("node"), F.sha2(text, 256).alias("hash"), "page_id", "record_start", "record_length")


def _parents(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each FANOUT consecutive nodes to one, hashed in order with their numbers."""
    child = F.concat_ws(":", F.col("node").cast("string"), "hash")
    up = nodes.groupBy(*keys, F.floor(F.col("node") / FANOUT).alias("node"))
    return up.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("node", child.alias("t"))))["t"], "\n"), 256).alias("hash"))


def tree(laid: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels over the records of each file (leaves first, up to its root), then levels over files."""
    inside = [leaves(laid)]
    span = FILE_RECORDS
    while span > 1:
        inside.append(materialize(_parents(inside[-1], ["file"]), "merkle"))
        span = -(-span // FANOUT)
    over = [inside[-1].select(F.col("file").alias("node"), "hash")]
    highest = over[0].agg(F.max(F.abs("node"))).first()[0] or 0
    while highest > 0:
        over.append(materialize(_parents(over[-1], []), "merkle"))
        highest //= FANOUT
    return inside, over


def _differing(a: DataFrame, b: DataFrame, keys: list[str], below: DataFrame | None) -> DataFrame:
    """Nodes whose hashes differ, among the children of the nodes below, if given."""
    if below is not None:
        wanted = below.select(*keys)
        cut = [
            x.withColumn("p", F.floor(F.col("node") / FANOUT)).join(wanted.withColumnRenamed("node", "p"), ["p", *[k for k in keys if k != "node"]], "left_semi").drop("p")
            for x in (a, b)
        ]
        a, b = cut
    left = a.select(*keys, F.col("hash").alias("hash_a"))
    right = b.select(*keys, F.col("hash").alias("hash_b"))
    return left.join(right, keys, "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record that differs: page_id, file, range in the primary and in the replica, problem."""
    spark = primary.sparkSession
    laid = [materialize(records(x), "records") for x in (primary, replica)]
    (in_a, over_a), (in_b, over_b) = (tree(x) for x in laid)
    height = max(len(over_a), len(over_b))
    for levels in (over_a, over_b):
        while len(levels) < height:
            levels.append(_parents(levels[-1], []))
    found = None
    for a, b in zip(reversed(over_a), reversed(over_b)):
        found = materialize(_differing(a, b, ["node"], found), "merkle-differs")
        if not found.limit(1).count():
            break
    if found.limit(1).count():
        # the files that differ, and in them only the branches that differ
        found = found.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node"))
        for a, b in list(zip(reversed(in_a), reversed(in_b)))[1:]:
            found = materialize(_differing(a, b, ["file", "node"], found), "merkle-differs")
        at = found.select("file", "node")
    else:
        at = spark.createDataFrame([], "file long, node long")
    sides = []
    for name, x in zip(("primary", "replica"), laid):
        leaf = x.select("file", F.col("slot").cast("long").alias("node"), F.col("record_start").alias(f"{name}_start"), F.col("record_length").alias(f"{name}_length"), F.col("digest").alias(f"{name}_digest"))
        sides.append(leaf.join(at, ["file", "node"], "left_semi"))
    both = sides[0].join(sides[1], ["file", "node"], "full_outer")
    problem = (
        F.when(F.col("replica_digest").isNull(), "missing in replica")
        .when(F.col("primary_digest").isNull(), "missing in primary")
        .when(F.col("primary_digest") != F.col("replica_digest"), "content")
        .otherwise("moved")
    )
    page = F.col("file") * FILE_RECORDS + F.col("node")
    return both.select(
        F.when(page != NO_ID, page).alias("page_id"), F.when(page != NO_ID, F.col("file")).alias("file"),
        "primary_start", "primary_length", "replica_start", "replica_length", problem.alias("problem"),
    )


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with faults set by the id: lost records, one byte changed in place, a tail cut off."""
    i = F.col("page_id")
    html = F.coalesce(F.col("html"), F.lit(""))
    changed = F.when(i % 211 == 17, F.concat(F.lit("~"), F.substring(html, 2, 1 << 30))).when(i % 997 == 401, F.expr("substring(coalesce(html, ''), 1, greatest(length(coalesce(html, '')) - 7, 0))")).otherwise(F.col("html"))
    return pages.filter(i.isNull() | (i % 1499 != 733)).withColumn("html", changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return audit(pages, decayed(pages))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, url, CASE WHEN page_id % 211 = 17 THEN '~' || substr(html, 2)
        WHEN page_id % 997 = 401 THEN substr(html, 1, greatest(length(html) - 7, 0)) ELSE html END AS html
      FROM p WHERE page_id % 1499 <> 733),
a AS (SELECT page_id, url, html, CAST(page_id // {FILE_RECORDS} AS BIGINT) AS file, 99 + strlen(url) + strlen(html) + length(CAST(strlen(html) AS VARCHAR)) AS n FROM p),
b AS (SELECT page_id, url, html, CAST(page_id // {FILE_RECORDS} AS BIGINT) AS file, 99 + strlen(url) + strlen(html) + length(CAST(strlen(html) AS VARCHAR)) AS n FROM r),
a2 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file ORDER BY page_id) - n AS BIGINT) AS s FROM a),
b2 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file ORDER BY page_id) - n AS BIGINT) AS s FROM b)
SELECT coalesce(a2.page_id, b2.page_id) AS page_id, coalesce(a2.file, b2.file) AS file,
  a2.s AS primary_start, CAST(a2.n AS BIGINT) AS primary_length, b2.s AS replica_start, CAST(b2.n AS BIGINT) AS replica_length,
  CASE WHEN b2.page_id IS NULL THEN 'missing in replica' WHEN a2.page_id IS NULL THEN 'missing in primary'
       WHEN a2.url <> b2.url OR a2.html <> b2.html THEN 'content' ELSE 'moved' END AS problem
FROM a2 FULL JOIN b2 ON a2.page_id = b2.page_id
WHERE a2.page_id IS NULL OR b2.page_id IS NULL OR a2.url <> b2.url OR a2.html <> b2.html OR a2.s <> b2.s OR a2.n <> b2.n
"""
