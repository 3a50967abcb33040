"""Binning on colour-filter lattices, exact roll-ups and residual pyramids.

All binning sums integers and counts and divides once, so coarser rungs come
from finer sums exactly and in any shuffle order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNGS = (16, 32, 64, 128, 256, 512)


def colour_of(y: Column, x: Column, bggr: bool = False) -> Column:
    """Filter colour of a site."""
    first, last = ("B", "R") if bggr else ("R", "B")
    return F.when((y % 2 == 0) & (x % 2 == 0), first).when((y % 2 == 1) & (x % 2 == 1), last).otherwise("G")


def phase_of(y: Column, x: Column) -> Column:
    return 2 * (y % 2) + x % 2


def channel_of(frame: Column, phase: Column) -> Column:
    return 4 * frame + phase


def phase_planes(mosaic: DataFrame) -> DataFrame:
    """Sites as (phase, py, px) and, with a frame, as the channel of a cycle tensor."""
    y, x = F.col("y"), F.col("x")
    out = mosaic.withColumn("phase", phase_of(y, x)).withColumn("py", F.floor(y / 2)).withColumn("px", F.floor(x / 2))
    return out.withColumn("channel", channel_of(F.col("frame"), F.col("phase"))) if "frame" in mosaic.columns else out


def interleaved(planes: DataFrame) -> DataFrame:
    """The inverse of ``phase_planes``."""
    p = F.col("phase")
    return planes.withColumn("y", 2 * F.col("py") + F.floor(p / 2)).withColumn("x", 2 * F.col("px") + p % 2)


def cell_sums(mosaic: DataFrame, keys: list[str], k: int, value: str) -> DataFrame:
    """Sums and counts by filter colour of k by k cells."""
    y, x = F.col("y"), F.col("x")
    c = colour_of(y, x)
    v = F.col(value)
    aggs = []
    for name in "RGB":
        aggs += [F.sum(F.when(c == name, v)).alias(f"s_{name.lower()}"), F.count(F.when(c == name, v)).alias(f"n_{name.lower()}")]
    return mosaic.groupBy(*keys, F.floor(y / k).alias("cy"), F.floor(x / k).alias("cx")).agg(*aggs)


def means(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, "cy", "cx", *[(F.col(f"s_{c}") / F.col(f"n_{c}")).alias(c) for c in "rgb"])


def rolled_up(sums: DataFrame, keys: list[str], times: int = 2) -> DataFrame:
    """Coarser sums from finer ones: sums and counts add."""
    cols = [c for c in sums.columns if c[:2] in ("s_", "n_")]
    return sums.groupBy(*keys, F.floor(F.col("cy") / times).alias("cy"), F.floor(F.col("cx") / times).alias("cx")).agg(*[F.sum(c).alias(c) for c in cols])


def rung_set(mosaic: DataFrame, keys: list[str], side: int, rungs: list[int], value: str) -> DataFrame:
    """Colour means at several rungs: the samples are grouped once, at the finest."""
    finest = max(rungs)
    sums = {finest: cell_sums(mosaic, keys, side // finest, value)}
    for r in sorted(rungs, reverse=True)[1:]:
        finer = min(x for x in sums if x > r)
        sums[r] = rolled_up(sums[finer], keys, finer // r)
    parts = [means(s, keys).withColumn("rung", F.lit(r).cast("long")) for r, s in sums.items()]
    return reduce(DataFrame.unionByName, parts)


def phase_bins(mosaic: DataFrame, keys: list[str], b: int, value: str) -> DataFrame:
    """Means of b by b same-phase sites, on a lattice b times smaller that keeps the phases."""
    place = lambda c: (2 * F.floor(F.col(c) / (2 * b)) + F.col(c) % 2).alias(c)
    return mosaic.groupBy(*keys, place("y"), place("x")).agg((F.sum(value) / F.count(value)).alias("v"))


def box_means(plane: DataFrame, keys: list[str], k: int, value: str) -> DataFrame:
    return plane.groupBy(*keys, F.floor(F.col("y") / k).alias("y"), F.floor(F.col("x") / k).alias("x")).agg((F.sum(value) / F.count(value)).alias("v"))


def admissible(side: Column) -> Column:
    """Rungs that divide a side into even cells."""
    return F.filter(F.array(*[F.lit(r).cast("long") for r in RUNGS]), lambda r: (side % r == 0) & (side / r >= 2) & ((side / r) % 2 == 0))


def prefix_length(rungs: Column, upto: Column) -> Column:
    return F.aggregate(F.filter(rungs, lambda r: r <= upto), F.lit(0).cast("long"), lambda acc, r: acc + r * r)


# ---------------------------------------------------------------- pyramids


def residuals(planes: DataFrame, keys: list[str]) -> DataFrame:
    """(rung, y, x, v) with rungs doubling to residuals against the parent's value."""
    base = planes.agg(F.min("rung").alias("base"))
    parent = planes.select(*keys, (F.col("rung") * 2).alias("rung"), F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("pv"))
    child = planes.withColumn("py", F.floor(F.col("y") / 2)).withColumn("px", F.floor(F.col("x") / 2))
    joined = child.join(parent, [*keys, "rung", "py", "px"], "left").crossJoin(F.broadcast(base))  # one row
    return joined.select(*keys, "rung", "y", "x", (F.col("v") - F.when(F.col("rung") == F.col("base"), 0).otherwise(F.col("pv"))).alias("residual"))


def decoded(stack: DataFrame, keys: list[str], rung: int, rungs: list[int]) -> DataFrame:
    """The plane at a rung: its places joined to every ancestor's residual, summed."""
    places = stack.filter(F.col("rung") == rung).select(*keys, "y", "x")
    levels = F.array(*[F.lit(r).cast("long") for r in rungs if r <= rung])
    up = places.withColumn("level", F.explode(levels)).withColumn("ay", F.floor(F.col("y") / (rung / F.col("level")))).withColumn("ax", F.floor(F.col("x") / (rung / F.col("level"))))
    at = stack.filter(F.col("rung") <= rung).select(*keys, F.col("rung").alias("level"), F.col("y").alias("ay"), F.col("x").alias("ax"), "residual")
    return up.join(at, [*keys, "level", "ay", "ax"]).groupBy(*keys, "y", "x").agg(F.sum("residual").alias("v"))


def upscaled(plane: DataFrame, keys: list[str], times: int) -> DataFrame:
    """Each place repeated times by times (an explode, no join)."""
    steps = F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))
    wide = plane.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return wide.select(*keys, (F.col("y") * times + F.col("dy")).alias("y"), (F.col("x") * times + F.col("dx")).alias("x"), "v")


def detail_energy(stack: DataFrame, keys: list[str], seed: int = 16) -> DataFrame:
    """Sum of absolute residuals above the base, on a seed by seed grid."""
    base = stack.agg(F.min("rung").alias("base"))
    fine = stack.crossJoin(F.broadcast(base)).filter("rung > base")  # one row
    cell = lambda c: F.floor(F.col(c) * seed / F.col("rung")).alias(c)
    return fine.groupBy(*keys, cell("y"), cell("x")).agg(F.sum(F.abs("residual")).alias("energy"))
