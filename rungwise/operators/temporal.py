"""Statistics over the frames of a cycle: means, residual variance, noise gain, alias discriminator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwise.operators.bins import cell_sums
from rungwise.operators.ordering import picked


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """sorted[n div 2] per key, exactly."""
    return picked(df, keys, [value], lambda n: F.array(F.floor(n / 2))).select(*keys, F.col(value).alias(out))


def bin_median(df: DataFrame, value: str, out: str) -> DataFrame:
    """sorted[n div 2] of a cycle's bins, whose number the rung fixes; cycles may be many."""
    values = F.sort_array(F.collect_list(value))
    return df.groupBy("cycle").agg(values.alias("_v")).select("cycle", F.element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int")).alias(out))


def deciles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[min(n - 1, i * n div 10)] for i = 0..10."""
    places = lambda n: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.least(n - 1, F.floor(i * n / 10)))
    return picked(df, keys, [value], places).select(*keys, F.col("_i").alias("decile"), F.col(value).alias("value"))


def _fold(terms: str, f) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + f(t))


def bin_statistics(frames: DataFrame, side: int, rung: int) -> DataFrame:
    """cycle, cy, cx with, per colour, the exposure-weighted mean and residual variance over frames, in frame order.

    ``frames`` has cycle, frame, ev, y, x, v with exposure-normalised v.
    """
    sums = cell_sums(frames, ["cycle", "frame", "ev"], side // rung, "v")
    q = (side // rung // 2) ** 2
    each = sums.withColumns({"r": F.col("s_r") / float(q), "g": F.col("s_g") / float(2 * q), "b": F.col("s_b") / float(q)})
    per = each.groupBy("cycle", "cy", "cx").agg(F.sort_array(F.collect_list(F.struct("frame", "ev", "r", "g", "b"))).alias("t"))
    per = per.withColumn("sum_e", _fold("t", lambda t: t["ev"])).withColumn("dof", (F.size("t") - 1).cast("double"))
    series = {"r": lambda t: t["r"], "g": lambda t: t["g"], "b": lambda t: t["b"], "q1": lambda t: t["r"] - t["g"], "q2": lambda t: t["b"] - t["g"]}
    per = per.withColumns({f"mu_{k}": _fold("t", lambda t, f=f: t["ev"] * f(t)) / F.col("sum_e") for k, f in series.items()})
    squares = {f"ss_{k}": _fold("t", lambda t, f=f, k=k: t["ev"] * (f(t) - F.col(f"mu_{k}")) * (f(t) - F.col(f"mu_{k}"))) for k, f in series.items()}
    return per.withColumns(squares).drop("t")


def cycle_statistics(frames: DataFrame, side: int, rung: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per bin mu and D, per cycle noise gain, per seed cell mean D)."""
    per = bin_statistics(frames, side, rung)
    q = float((side // rung // 2) ** 2)
    size = {"r": q, "g": 2 * q, "b": q}
    ratios = F.array(*[F.when(F.col(f"mu_{c}") > 0, F.col(f"ss_{c}") / F.col("dof") / (F.col(f"mu_{c}") / F.lit(size[c]))).otherwise(0.0) for c in "rgb"])
    gain = bin_median(per.select("cycle", F.explode(ratios).alias("ratio")), "ratio", "gain")
    both = per.join(gain, "cycle")
    noise = {c: F.col("gain") * F.col(f"mu_{c}") / F.lit(size[c]) for c in "rgb"}

    def part(k: str, a: str) -> Column:
        v = noise[a] + noise["g"]
        return F.when(v > 0, F.col(f"ss_{k}") / (F.col("dof") * v)).otherwise(0.0)

    bins = both.withColumn("d", (part("q1", "r") + part("q2", "b")) / 2).select("cycle", "cy", "cx", "mu_r", "mu_g", "mu_b", "d")
    f = rung // seed
    blocks = bins.groupBy("cycle", F.floor(F.col("cy") / f).alias("sy"), F.floor(F.col("cx") / f).alias("sx")).agg(
        F.sort_array(F.collect_list(F.struct("cy", "cx", "d"))).alias("ds")
    )
    sigma = blocks.select("cycle", "sy", "sx", (F.aggregate("ds", F.lit(0.0), lambda acc, t: acc + t["d"]) / float(f * f)).alias("sigma_time"))
    return bins, gain, sigma


def region_median(bins: DataFrame, where: Column, value: str) -> DataFrame:
    return bin_median(bins.filter(where), value, "median")
