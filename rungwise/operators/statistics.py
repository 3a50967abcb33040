"""Report statistics: stage timings, histograms, envelopes, correlations, fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.operators import ordering


def stage_report(stages: DataFrame) -> DataFrame:
    """Calls, midpoint median, maximum and total per stage."""
    sums = stages.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.max("ms").alias("max_ms"), F.round(F.sum(F.round(F.col("ms") * 1e6).cast("long")) / 1e6, 6).alias("total_ms"))
    middle = ordering.picked(stages.select("stage", "ms").filter("ms IS NOT NULL"), ["stage"], ["ms"], lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    middle = middle.groupBy("stage").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    median = (F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5).alias("median_ms")
    return sums.join(ordering.few(middle), "stage", "left").select("stage", "calls", median, "max_ms", "total_ms")


def first_calls(stages: DataFrame, most: int = 128) -> DataFrame:
    ranks = ordering.ranked(stages, ["stage"], ["moment", "call"])
    return ranks.filter(F.col("_r") < most).withColumn("nth", F.col("_r") + 1).drop("_r", "_n")


def timeline(stages: DataFrame) -> DataFrame:
    """Stages by their first start, with each one's share of the largest total."""
    spans = stages.groupBy("stage").agg(F.min("moment").alias("first_at"), F.max("moment").alias("last_at"), F.max("ms").alias("peak_ms"))
    top = spans.agg(F.max("peak_ms").alias("top"))
    return spans.crossJoin(F.broadcast(top)).select("stage", "first_at", "last_at", (F.col("peak_ms") / F.col("top")).alias("heat"))


def equal_width(values: DataFrame, keys: list[str], value: str, n: int = 10) -> DataFrame:
    """Counts in n buckets over each key's own range; the last bucket is closed."""
    spans = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ranged = values.join(ordering.few(spans), keys)
    width = (F.col("_hi") - F.col("_lo")) / n
    bucket = F.when(width == 0, F.lit(0).cast("long")).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(n - 1).cast("long")))
    return ranged.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fixed_range(values: DataFrame, keys: list[str], value: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts in n buckets over a fixed range, values outside dropped, the top value in the last bucket."""
    width = (hi - lo) / n
    inside = values.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    return inside.groupBy(*keys, F.least(F.floor((F.col(value) - lo) / width), F.lit(n - 1).cast("long")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def majority(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per key, the lowest among equals."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct((-F.col("n")).alias("m"), F.col(label))).alias(label), F.max("n").alias("n"))


def top_codes(rows: DataFrame, code: str, k: int = 10) -> DataFrame:
    """The k most frequent codes and their shares, ties to the lower code (a top-k report)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), code).limit(k)
    return counts.crossJoin(F.broadcast(total)).select(code, "n", (F.col("n") / F.col("total")).alias("share"))


def correlation(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of integer columns from exact sums; null without variance."""
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy"),
    )
    d = lambda c: c.cast("double")
    n, sx, sy = d(F.col("n")), d(F.col("sx")), d(F.col("sy"))
    vx, vy = n * d(F.col("sxx")) - sx * sx, n * d(F.col("syy")) - sy * sy
    return s.select(*keys, F.when((vx > 0) & (vy > 0), (n * d(F.col("sxy")) - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))).alias("r"))


def ordered_pick(rows: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """sorted[floor(n * q)] per key."""
    return ordering.picked(rows.select(*keys, value), keys, [value], lambda n: F.array(F.least(F.floor(n * F.lit(q)), n - 1))).select(*keys, F.col(value).alias(out))


def second_differences(rows: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """x[0] - 2 x[2] + x[4] along a series: neighbours of the same filter colour."""
    w = Window.partitionBy(*series).orderBy(order)
    return rows.withColumn("d2", F.col(value) - 2 * F.lead(value, 2).over(w) + F.lead(value, 4).over(w))


def rank_buckets(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Bucket floor(rank * n / count) of each row."""
    return ordering.ranked(rows, keys, [value]).withColumn("bucket", F.floor(F.col("_r") * n / F.col("_n"))).drop("_r", "_n")


def line_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def scaled_trail(rows: DataFrame, series: list[str], order: list[str], value: str, n: int = 32) -> DataFrame:
    """A value between the least and greatest of the trailing n rows."""

    def made(w) -> dict[str, Column]:
        lo, hi = F.min(value).over(w), F.max(value).over(w)
        return {"scaled": F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)}

    return ordering.trailing(rows, series, order, n, made)


def combined_weights(rows: DataFrame, keys: list[str], a: str, b: str, blend: float, lo: float = 0.25, hi: float = 4.0) -> DataFrame:
    """Two weights, each scaled to mean 1, blended with an even one and kept in [lo, hi]; their product scaled to mean 1 and kept there too."""
    kept = lambda c: F.greatest(F.lit(lo), F.least(c, F.lit(hi)))
    w = Window.partitionBy(*keys)
    scaled = lambda c: c / (F.avg(c).over(w) + 1e-12)
    product = rows.withColumn("_p", kept(1 - blend + blend * scaled(F.col(a))) * kept(1 - blend + blend * scaled(F.col(b))))
    return product.withColumn("weight", kept(scaled(F.col("_p")))).drop("_p")


def share(condition: Column) -> Column:
    return F.count_if(condition) / F.count(F.lit(1))
