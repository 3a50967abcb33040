"""Palettes: nearest entries, windowed choices, seeds and rank targets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.functions import lattice as L
from rungwise.functions.colour import delta_squared

GRID = 16
SEED_CHROMA = 0.10
#: Colours of each of the 16 lightness strata (fixed values).
BELL_COUNTS = (1, 1, 2, 4, 8, 16, 32, 64, 64, 32, 16, 8, 4, 2, 1, 1)


def packed(palette: DataFrame) -> DataFrame:
    """The palette as one row holding an ordered array: at most 256 entries."""
    return palette.agg(F.sort_array(F.collect_list(F.struct("idx", "l", "a", "b"))).alias("entries"))


def nearest(targets: DataFrame, palette: DataFrame) -> DataFrame:
    """Targets with ``idx`` of the nearest entry, the lowest among equals. Map-only: one broadcast row."""
    both = targets.crossJoin(F.broadcast(packed(palette)))
    near = F.transform("entries", lambda p: F.struct(delta_squared([p["l"], p["a"], p["b"]], [F.col("l"), F.col("a"), F.col("b")]).alias("d2"), p["idx"].alias("idx")))
    return both.withColumn("near", F.array_min(near)).select(*targets.columns, F.col("near.idx").alias("idx"), F.col("near.d2").alias("d2"))


def alternatives(targets: DataFrame, palette: DataFrame, k: int = 8) -> DataFrame:
    """The k nearest entries of each target in order of distance, then index: pos, rank, idx, d2."""
    both = targets.crossJoin(F.broadcast(packed(palette)))
    near = F.transform("entries", lambda p: F.struct(delta_squared([p["l"], p["a"], p["b"]], [F.col("l"), F.col("a"), F.col("b")]).alias("d2"), p["idx"].alias("idx")))
    ranked = both.select("pos", F.slice(F.sort_array(near), 1, k).alias("near")).select("pos", F.posexplode("near").alias("rank", "near"))
    return ranked.select("pos", F.col("rank").cast("long").alias("rank"), F.col("near.idx").alias("idx"), F.col("near.d2").alias("d2"))


def window_choice(targets: DataFrame, palette: DataFrame, side: int, r: int = 2) -> DataFrame:
    """The nearest entry among the (2r+1)^2 window around a site's home cell, the first in row order among equals."""
    hv, hu = L.home(F.col("y"), F.col("x"), side)
    both = targets.withColumns({"hv": hv, "hu": hu}).crossJoin(F.broadcast(packed(palette)))
    inside = F.filter(
        "entries", lambda p: (F.abs(L.whole(p["idx"], GRID) - F.col("hv")) <= r) & (F.abs(p["idx"] % GRID - F.col("hu")) <= r)
    )
    near = F.transform(inside, lambda p: F.struct(delta_squared([p["l"], p["a"], p["b"]], [F.col("l"), F.col("a"), F.col("b")]).alias("d2"), p["idx"].alias("idx")))
    return both.withColumn("near", F.array_min(near)).select("y", "x", F.col("near.idx").alias("idx"), F.col("near.d2").alias("d2"))


def coloured(indices: DataFrame, palette: DataFrame) -> DataFrame:
    """Index to colour; the palette is a dimension of at most 256 rows."""
    return indices.join(F.broadcast(palette), "idx")


def seed_palette(spark: SparkSession) -> DataFrame:
    """Rows of lightness by columns of hue at fixed chroma."""
    i = F.col("id")
    v, u = L.whole(i, GRID), i % GRID
    theta = F.lit(2 * math.pi) * u / GRID
    return spark.range(256).select(
        i.alias("idx"), (F.lit(0.15) + F.lit(0.7) * v / (GRID - 1)).alias("L"), (SEED_CHROMA * F.cos(theta)).alias("A"), (SEED_CHROMA * F.sin(theta)).alias("B")
    )


def strata(spark: SparkSession) -> DataFrame:
    """idx, stratum, place, count of the bell allocation, from the stratum counts."""
    rows, start = [], 0
    for k, n in enumerate(BELL_COUNTS):
        rows.append((k, start, n))
        start += n
    each = spark.createDataFrame(rows, "stratum long, start long, count long")
    return each.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).select((F.col("start") + F.col("place")).alias("idx"), "stratum", "place", "count")


def bell_palette(spark: SparkSession) -> DataFrame:
    """The bell allocation: lightness within strata, hue around, ends exactly black and white."""
    light = (F.col("stratum") + (F.col("place") + 0.5) / F.col("count")) / 16
    theta = F.lit(2 * math.pi) * F.col("place") / F.col("count")
    chroma = F.when(F.col("count") < 4, 0.0).otherwise(SEED_CHROMA)
    end = F.col("idx").isin(0, 255)
    return strata(spark).select(
        "idx",
        F.when(F.col("idx") == 0, 0.0).when(F.col("idx") == 255, 1.0).otherwise(light).alias("L"),
        F.when(end, 0.0).otherwise(chroma * F.cos(theta)).alias("A"),
        F.when(end, 0.0).otherwise(chroma * F.sin(theta)).alias("B"),
    )


def bell_targets(spark: SparkSession) -> DataFrame:
    """rank and the lightness it should have."""
    return bell_palette(spark).select(F.col("idx").alias("rank"), F.col("L").alias("target"))


def by_rank(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each value's target by its rank in its group, ties by index."""
    w = Window.partitionBy(*keys).orderBy("l", "idx")
    ranked = values.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    return ranked.join(F.broadcast(targets), "rank")


def remapped(values: DataFrame, knots: DataFrame) -> DataFrame:
    """Piecewise linear map through sorted knots (k, to), constant beyond the ends; knots are few."""
    ends = knots.agg(F.sort_array(F.collect_list(F.struct("k", "to"))).alias("knots"))
    both = values.crossJoin(F.broadcast(ends))
    below = F.filter("knots", lambda p: p["k"] <= F.col("l"))
    above = F.filter("knots", lambda p: p["k"] > F.col("l"))
    lo, hi = F.element_at(below, -1), F.element_at(above, 1)
    both = both.withColumns({"n_lo": F.size(below), "n_hi": F.size(above)})
    lo, hi = F.when(F.col("n_lo") > 0, lo), F.when(F.col("n_hi") > 0, hi)
    step = (F.col("l") - lo["k"]) / (hi["k"] - lo["k"])
    out = F.when(F.col("n_lo") == 0, hi["to"]).when(F.col("n_hi") == 0, lo["to"]).otherwise(lo["to"] + step * (hi["to"] - lo["to"]))
    return both.select(*values.columns, out.alias("mapped"))
