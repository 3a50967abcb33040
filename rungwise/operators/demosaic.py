"""Full-resolution demosaic by windows along rows and columns, for reference rungs.

Green follows the smaller of two directional gradients; red and blue are
interpolated as differences from green. Borders repeat the nearest site.
Sites with integer counts give dyadic values, so every mean is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(name: str, rows, columns) -> dict[str, Column]:
    """Neighbours one and two sites away in four directions, clamped at the border."""
    out = {}
    for side, f, w in (("w", F.lag, rows), ("e", F.lead, rows), ("n", F.lag, columns), ("s", F.lead, columns)):
        near, far = f(name, 1).over(w), f(name, 2).over(w)
        out[f"{side}1"] = F.coalesce(near, F.col(name))
        out[f"{side}2"] = F.coalesce(far, near, F.col(name))
    return out


def _either(name: str, w) -> Column:
    """Mean of the two neighbours along a window; where one is missing, the other."""
    a, b = F.lag(name, 1).over(w), F.lead(name, 1).over(w)
    return (F.coalesce(a, b) + F.coalesce(b, a)) / 2


def full_colour(mosaic: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, y, x, r, g, b of a complete lattice."""
    rows, columns = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    at = mosaic.select(*keys, "y", "x", F.col(value).cast("double").alias("v"))
    at = at.withColumns(_along("v", rows, columns))
    v, c = F.col("v"), {k: F.col(k) for k in ("w1", "e1", "n1", "s1", "w2", "e2", "n2", "s2")}
    across, down = 2 * v - c["w2"] - c["e2"], 2 * v - c["n2"] - c["s2"]
    at = at.withColumns({"dh": F.abs(c["w1"] - c["e1"]) + F.abs(across), "dv": F.abs(c["n1"] - c["s1"]) + F.abs(down)})
    flat = (c["w1"] + c["e1"] + c["n1"] + c["s1"]) / 4 + (across + down) / 8
    guess = F.when(F.col("dh") < F.col("dv"), (c["w1"] + c["e1"]) / 2 + across / 4).when(F.col("dv") < F.col("dh"), (c["n1"] + c["s1"]) / 2 + down / 4).otherwise(flat)
    at = at.select(*keys, "y", "x", "v", F.when((F.col("y") + F.col("x")) % 2 == 1, v).otherwise(guess).alias("g"))
    for name, phase in (("r", 0), ("b", 1)):
        on_row, on_col = F.col("y") % 2 == phase, F.col("x") % 2 == phase
        at = at.withColumn("d", F.when(on_row & on_col, F.col("v") - F.col("g")))
        at = at.withColumn("h", F.when(on_row, F.coalesce("d", _either("d", rows))))
        at = at.withColumn(name, F.coalesce("h", _either("h", columns)) + F.col("g"))
    return at.select(*keys, "y", "x", "r", "g", "b")
