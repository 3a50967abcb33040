"""Scene histograms, percentiles by cumulative walk, and exposure plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.functions.lattice import bin_centre, bin_index, room_stops

BINS = 1024
AIM, BRIGHT, SHADOW = 0.95, 0.995, 0.02
PRESENT, SHADOW_AIM, MOST = 0.02, 0.25, 5.0
SHADOW_LEAST, SHADOW_MOST = 1.0, 4.0


def histogram(values: DataFrame, keys: list[str], value: str, n: int = BINS) -> DataFrame:
    return values.groupBy(*keys, bin_index(F.col(value), n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentile(hist: DataFrame, keys: list[str], q: float, out: str, n: int = BINS) -> DataFrame:
    """Centre of the first bin where the running count reaches q of all."""
    w = Window.partitionBy(*keys)
    run = hist.withColumn("_c", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("n").over(w))
    hit = run.filter(F.col("_c") >= F.col("_t") * F.lit(q))
    return hit.groupBy(*keys).agg(bin_centre(F.min("bin"), n).alias(out))


def clips(hist: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Per key the room of each channel, its presence and the shadow frame's depth."""
    high = percentile(hist, [*keys, channel], BRIGHT, "high")
    low = percentile(hist.filter(F.col(channel) == "G"), keys, SHADOW, "low")
    pick = lambda c: F.max(F.when(F.col(channel) == c, F.col("high")))
    wide = high.groupBy(*keys).agg(*[pick(c).alias(f"hi_{c.lower()}") for c in "RGB"]).join(low, keys, "left")
    present = {c: F.coalesce(F.col(f"hi_{c}"), F.lit(0.0)) >= PRESENT for c in "rgb"}
    room = {c: F.when(present[c], room_stops(F.col(f"hi_{c}"), AIM)).otherwise(0.0) for c in "rgb"}
    want = room_stops(F.greatest(F.coalesce("low", F.lit(0.0)), F.lit(1e-4)), SHADOW_AIM)
    depth = F.greatest(F.lit(SHADOW_LEAST), F.least(want - room["g"], F.lit(SHADOW_MOST)))
    return wide.select(*keys, *[room[c].alias(f"room_{c}") for c in "rgb"], depth.alias("shadow_depth"), *[present[c].alias(f"present_{c}") for c in "rgb"])


def planned(clips_: DataFrame, keys: list[str], wb: tuple[float, float, float], extra: float = 0.0) -> DataFrame:
    """Exposure offsets of the four frames; absent channels lean on the white balance."""
    prior = {c: max(-MOST, min(math.log2(max(w, 1e-4) / max(wb[1], 1e-4)), MOST)) for c, w in (("r", wb[0]), ("b", wb[2]))}
    g = F.col("room_g")
    ev = {c: F.when(F.col(f"present_{c}"), F.col(f"room_{c}")).otherwise(g + prior[c]) for c in "rb"}
    return clips_.select(*keys, g.alias("ev_green"), ev["r"].alias("ev_red"), ev["b"].alias("ev_blue"), (g + F.col("shadow_depth") + extra).alias("ev_shadow"))


def bounded_plan(plan: Column, seed: float, least: float, most: float) -> Column:
    """A plan within bounds; the seed where there is none."""
    return F.greatest(F.lit(least), F.least(F.coalesce(plan, F.lit(seed)), F.lit(most)))


def base_frame(biases: Column) -> Column:
    """Place of the smallest absolute bias, the first among equals."""
    keyed = F.transform(biases, lambda b, i: F.struct(F.abs(b).alias("k"), i.alias("i")))
    return F.array_min(keyed)["i"]


def last_known(plans: DataFrame, series: list[str], order: str, plan: str) -> DataFrame:
    """The latest plan before each row (one at least behind), nulls skipped."""
    w = Window.partitionBy(*series).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return plans.withColumn("known", F.last(plan, ignorenulls=True).over(w))
