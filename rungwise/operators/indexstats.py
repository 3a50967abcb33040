"""Statistics of palette index streams: usage, balance, entropy, churn and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.functions import lattice as L

OPTIONS = 256


def usage(indices: DataFrame, keys: list[str]) -> DataFrame:
    """Count of each of the 256 options per key, zeros included (256 rows a key, made after the counting)."""
    counts = indices.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("n"))
    filled = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("idx", "n"))).alias("seen"))
    options = F.sequence(F.lit(0).cast("long"), F.lit(OPTIONS - 1).cast("long"))
    return filled.withColumn("idx", F.explode(options)).select(*keys, "idx", F.coalesce(F.try_element_at("seen", F.col("idx")), F.lit(0).cast("long")).alias("n"))


def balance(indices: DataFrame, keys: list[str]) -> DataFrame:
    """n, chi2 against equal use (exact over the integers until one division), bits lost and entropy per key."""
    counts = indices.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("c"))
    summed = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.sort_array(F.collect_list("c")).alias("cs"))
    chi2 = (OPTIONS * F.col("sq") - F.col("n") * F.col("n")) / F.col("n")
    entropy = F.aggregate("cs", F.lit(0.0), lambda acc, c: acc - (c / F.col("n")) * F.log2(c / F.col("n")))
    return summed.select(*keys, "n", chi2.alias("chi2"), (chi2 / (2 * F.log(F.lit(2.0)))).alias("bits_lost"), entropy.alias("entropy"))


def changes(indices: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """Rows whose index differs from the one before in their series."""
    w = Window.partitionBy(*series).orderBy(*order)
    return indices.withColumn("before", F.lag("idx").over(w)).filter(F.col("before").isNotNull() & (F.col("before") != F.col("idx")))


def churn(indices: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """Steps and changed steps per series."""
    w = Window.partitionBy(*series).orderBy(*order)
    seen = indices.withColumn("before", F.lag("idx").over(w))
    return seen.groupBy(*series).agg(F.count("before").alias("steps"), F.count_if(F.col("before") != F.col("idx")).alias("churn"))


def delta(one: DataFrame, other: DataFrame) -> DataFrame:
    """(pos, idx) of the other frame where it differs from the first."""
    return one.select("pos", F.col("idx").alias("before")).join(other, "pos").filter(F.col("before") != F.col("idx")).select("pos", "idx")


def applied(base: DataFrame, changes_: DataFrame) -> DataFrame:
    """The base frame with a delta over it."""
    new = changes_.select("pos", F.col("idx").alias("new"))
    return base.join(new, "pos", "left").select("pos", F.coalesce("new", "idx").alias("idx"))


def home_share(frame: DataFrame, side: int, keys: list[str]) -> DataFrame:
    """Share of sites whose index names their own patch."""
    v, u = L.home(F.col("y"), F.col("x"), side)
    return frame.groupBy(*keys).agg(F.avg((F.col("idx") == v * 16 + u).cast("double")).alias("home_share"))


def centroids(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys, "idx").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def moved(usage_: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Usage after one site moves from an option to another."""
    step = F.when(F.col("idx") == source, -1).when(F.col("idx") == target, 1).otherwise(0)
    return usage_.select(*keys, "idx", (F.col("n") + F.when(F.lit(source == target), 0).otherwise(step)).alias("n"))


def expected_balance(n: Column) -> Column:
    """Mean of the balance statistic under uniform chance: 255 for every n."""
    return F.lit(256.0) / n * 256 * (n * F.lit(1 / 256) * F.lit(255 / 256))
