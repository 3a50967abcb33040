"""Brackets of exposures: relative exposure, fusion weights and fusion aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL_RATIO = 1.0353
LARGEST_RATIO = 256.0
CLIP = 0.98
KNEE = 0.90


def normalised(dn: Column, black: float, white: float) -> Column:
    """The affine map of counts to [0, 1] (values outside stay outside)."""
    return (dn - F.lit(black)) / F.lit(white - black)


def ev_normalised(dn: Column, exposure: Column, black: float, white: float) -> Column:
    """Counts over exposure, never below zero."""
    scale = F.lit(1.0) / exposure / F.lit(max(white - black, 1.0))
    return F.greatest((dn - F.lit(black)) * scale, F.lit(0.0))


def relative_exposure(frames: DataFrame) -> DataFrame:
    """Per frame the exposure over the darkest one's of its cycle, in [1, 256].

    A cycle with a time that is not positive, or whose spread is within a
    twentieth of a stop, counts as equally exposed.
    """
    w = Window.partitionBy("cycle")
    e = F.col("iso") * F.col("t") / (F.col("f_number") * F.col("f_number"))
    seen = frames.withColumn("e", e).withColumn("e_min", F.min("e").over(w)).withColumn("e_max", F.max("e").over(w)).withColumn("bad", F.max((F.col("t") <= 0).cast("int")).over(w))
    equal = (F.col("bad") == 1) | (F.col("e_min") <= 0) | (F.col("e_max") / F.nullif(F.col("e_min"), F.lit(0.0)) <= EQUAL_RATIO)
    ratio = F.greatest(F.lit(1.0), F.least(F.lit(LARGEST_RATIO), F.col("e") / F.nullif(F.col("e_min"), F.lit(0.0))))
    return seen.select(*frames.columns, F.when(equal, 1.0).otherwise(ratio).alias("rel_e"))


def likelihood_weight(y: Column, e: Column, s: Column, o: Column, clip: float = CLIP) -> Column:
    """Inverse variance of an observation; none once it is censored."""
    return F.when(y >= clip, 0.0).otherwise(e * e / (s * F.greatest(y, F.lit(0.0)) + o))


def heuristic_weight(y: Column, knee: float = KNEE, clip: float = CLIP) -> Column:
    """Signal times a roll-off towards saturation."""
    roll = F.greatest(F.lit(0.0), F.least((F.lit(clip) - y) / F.lit(clip - knee), F.lit(1.0)))
    return F.greatest(y, F.lit(0.0)) * roll


def _folded(rows: DataFrame, keys: list[str], weight: Column, value: Column, fallback) -> DataFrame:
    """Weighted mean over frames in frame order, one fold per place, so no shuffle order shows."""
    terms = rows.withColumn("w", weight).withColumn("v", value)
    grouped = terms.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("frame", "w", "v"))).alias("terms"), fallback.alias("fallback")
    )
    num = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["w"] * t["v"])
    den = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["w"])
    return grouped.withColumn("num", num).withColumn("den", den)


def fuse_likelihood(rows: DataFrame, keys: list[str], clip: float = CLIP) -> DataFrame:
    """Fused value per place from frame, y, e, s, o; where all is censored, the first darkest frame's."""
    out = _folded(rows, keys, likelihood_weight(F.col("y_obs"), F.col("e"), F.col("s"), F.col("o"), clip), F.col("y_obs") / F.col("e"), F.min_by(F.col("y_obs") / F.col("e"), F.struct("e", "frame")))
    return out.select(*keys, F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("fallback")).alias("fused"))


def fuse_heuristic(rows: DataFrame, keys: list[str], knee: float = KNEE, clip: float = CLIP) -> DataFrame:
    """Fused value per place by signal and roll-off; where no weight is left, the least scene value."""
    out = _folded(rows, keys, heuristic_weight(F.col("y_obs"), knee, clip), F.col("y_obs") / F.col("e"), F.min(F.col("y_obs") / F.col("e")))
    return out.select(*keys, F.when(F.col("den") > 1e-8, F.col("num") / F.col("den")).otherwise(F.col("fallback")).alias("fused"))


def with_profiles(frames: DataFrame) -> DataFrame:
    """Whether every frame of a cycle has a noise profile, which chooses the fusion."""
    return frames.groupBy("cycle").agg(F.bool_and((F.coalesce("s", F.lit(0.0)) > 0) & (F.coalesce("o", F.lit(0.0)) > 0)).alias("likelihood"))


def rails(frames: DataFrame, clip_dn: int, black: int) -> DataFrame:
    """Share of counts at or above the clip, and below black, per cycle and frame."""
    n = F.count(F.lit(1))
    return frames.groupBy("cycle", "frame").agg((F.count_if(F.col("dn") >= clip_dn) / n).alias("clipped"), (F.count_if(F.col("dn") < black) / n).alias("below_black"))
