"""A reproducible colour path: pinned operations on doubles, then fixed point.

Every product and sum is written in the order it must be evaluated in, so the
results agree bit for bit with any other IEEE engine that keeps the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M3 = list[list[float]]

# Published colour matrices, row by row.
PROPHOTO_TO_XYZ_D50: M3 = [[0.7976749, 0.1351917, 0.0313534], [0.2880402, 0.7118741, 0.0000857], [0.0, 0.0, 0.8252100]]
XYZ_TO_PROPHOTO_D50: M3 = [[1.3459434, -0.2556075, -0.0511118], [-0.5445988, 1.5081673, 0.0205351], [0.0, 0.0, 1.2118128]]
D50_TO_D65: M3 = [[0.9555766, -0.0230393, 0.0631636], [-0.0282895, 1.0099416, 0.0210077], [0.0122982, -0.0204830, 1.3299098]]
SRGB_TO_XYZ_D65: M3 = [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]
XYZ_D65_TO_LMS: M3 = [[0.8189330101, 0.3618667424, -0.1288597137], [0.0329845436, 0.9293118715, 0.0361456387], [0.0482003018, 0.2643662691, 0.6338517070]]
LMS_TO_LAB: M3 = [[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]]
SRGB_TO_LMS: M3 = [[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]
CONE: M3 = [[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]]
LAB_TO_LMS_ROOT: M3 = [[1.0, 0.3963377774, 0.2158037573], [1.0, -0.1055613458, -0.0638541728], [1.0, -0.0894841775, -1.2914855480]]
LMS_TO_SRGB: M3 = [[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.7076147010]]
CBRT_2 = 1.2599210498948731647672106072782
CBRT_4 = 1.5874010519681994747517056392723
Q16 = 65536
TABLE_SIZE = 4096

# ---------------------------------------------------------------- matrices, on the driver


def apply3(m: M3, v):
    """Rows times a vector, left to right; v holds numbers or columns."""
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m]


def mul3(a: M3, b: M3) -> M3:
    columns = [apply3(a, [row[j] for row in b]) for j in range(3)]
    return [[columns[j][i] for j in range(3)] for i in range(3)]


def inv3(m: M3) -> M3 | None:
    """Inverse by cofactors; nothing where the determinant is within 1e-12 of zero."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if abs(det) <= 1e-12:
        return None
    over = 1 / det
    cofactors = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return [[x * over for x in row] for row in cofactors]


def diagonal(v) -> M3:
    return [[v[0], 0.0, 0.0], [0.0, v[1], 0.0], [0.0, 0.0, v[2]]]


def white_d50() -> list[float]:
    return apply3(PROPHOTO_TO_XYZ_D50, [1.0, 1.0, 1.0])


def adaptation_to_d50(white) -> M3:
    here, there = apply3(CONE, white), apply3(CONE, white_d50())
    return mul3(inv3(CONE), mul3(diagonal([t / h for t, h in zip(there, here)]), CONE))


def camera_by_forward(forward: M3, neutral) -> M3:
    """Camera to linear working space through a forward matrix of white-balanced counts."""
    r, g, b = neutral
    gains = [g / r, 1.0, g / b]
    return mul3(XYZ_TO_PROPHOTO_D50, [[x * m for x, m in zip(row, gains)] for row in forward])


def camera_by_colour(colour: M3, neutral) -> M3:
    """Camera to linear working space through an inverted colour matrix; white balance is implied."""
    back = inv3(colour)
    x, y, z = apply3(back, neutral)
    return mul3(XYZ_TO_PROPHOTO_D50, mul3(adaptation_to_d50([x / y, 1.0, z / y]), back))


def camera_matrix(neutral, forward2=None, forward1=None, colour2=None, colour1=None) -> M3 | None:
    """The first path that the file's tags allow."""
    forward = forward2 or forward1
    if forward:
        return camera_by_forward(forward, neutral)
    colour = colour2 or colour1
    return camera_by_colour(colour, neutral) if colour else None


def neutral_spread(m: M3, neutral) -> float:
    """(max - min) / max of the neutral's image: zero for a lawful matrix."""
    v = apply3(m, neutral)
    return (max(v) - min(v)) / max(v)


def prophoto_to_lms() -> M3:
    return mul3(XYZ_D65_TO_LMS, mul3(D50_TO_D65, PROPHOTO_TO_XYZ_D50))


# ---------------------------------------------------------------- columns


def scaled_inverse(df: DataFrame, m: list[str], out: list[str]) -> DataFrame:
    """Nine columns of a matrix per row to nine of its inverse, null where singular."""
    a, b, c, d, e, f, g, h, i = (F.col(x) for x in m)
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    over = F.when(F.abs(F.col("_det")) > 1e-12, F.lit(1.0) / F.col("_det"))
    entries = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return df.withColumn("_det", det).withColumns({n: x * over for n, x in zip(out, entries)}).drop("_det")


def with_cube_roots(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace columns by their pinned cube roots: four Newton steps on a mantissa in [1, 2).

    Steps are separate projections; one nested expression would outgrow the
    code generator's method limit.
    """
    sign = {f"_s_{n}": F.when(F.col(n) < 0, -1.0).when(F.col(n) > 0, 1.0).otherwise(0.0) for n in names}
    df = df.withColumns(sign | {f"_x_{n}": F.when(F.col(n) == 0, 1.0).otherwise(F.abs(F.col(n))) for n in names})
    df = df.withColumns({f"_e_{n}": F.floor(F.log2(F.col(f"_x_{n}"))) for n in names})
    df = df.withColumns({f"_f_{n}": F.col(f"_x_{n}") / F.pow(F.lit(2.0), F.col(f"_e_{n}").cast("double")) for n in names})
    # the logarithm may round across a power of two
    df = df.withColumns(
        {f"_e_{n}": F.col(f"_e_{n}") + F.when(F.col(f"_f_{n}") >= 2, 1).when(F.col(f"_f_{n}") < 1, -1).otherwise(0) for n in names}
        | {f"_f_{n}": F.when(F.col(f"_f_{n}") >= 2, F.col(f"_f_{n}") / 2).when(F.col(f"_f_{n}") < 1, F.col(f"_f_{n}") * 2).otherwise(F.col(f"_f_{n}")) for n in names}
    )
    df = df.withColumns({f"_y_{n}": F.lit(0.75) + F.col(f"_f_{n}") / 4 for n in names})
    for _ in range(4):
        df = df.withColumns({f"_y_{n}": (F.lit(2.0) * F.col(f"_y_{n}") + F.col(f"_f_{n}") / (F.col(f"_y_{n}") * F.col(f"_y_{n}"))) / 3 for n in names})
    third = {n: F.pmod(F.col(f"_e_{n}"), F.lit(3)) for n in names}
    root = {
        n: F.col(f"_s_{n}")
        * (F.col(f"_y_{n}") * F.when(third[n] == 0, 1.0).when(third[n] == 1, CBRT_2).otherwise(CBRT_4))
        * F.pow(F.lit(2.0), F.floor(F.col(f"_e_{n}") / 3).cast("double"))
        for n in names
    }
    return df.withColumns(root).drop(*[f"_{k}_{n}" for k in "sxefy" for n in names])


def quantised(x: Column) -> Column:
    return F.floor(x * F.lit(float(Q16)) + F.lit(0.5))


def dequantised(q: Column) -> Column:
    return q.cast("double") / F.lit(float(Q16))


def to_oklab(df: DataFrame, rgb: list[str], lab: list[str], matrix: M3 | None = None) -> DataFrame:
    """Linear columns to L, a, b, through LMS by ``matrix`` (the working space's by default)."""
    lms = apply3(matrix or prophoto_to_lms(), [F.col(c) for c in rgb])
    df = df.withColumns({f"_lms{k}": x for k, x in enumerate(lms)})
    df = with_cube_roots(df, ["_lms0", "_lms1", "_lms2"])
    out = apply3(LMS_TO_LAB, [F.col(f"_lms{k}") for k in range(3)])
    return df.withColumns(dict(zip(lab, out))).drop("_lms0", "_lms1", "_lms2")


def to_linear_display(df: DataFrame, lab: list[str], rgb: list[str]) -> DataFrame:
    """L, a, b to linear display primaries; no roots."""
    big, a, b = (F.col(c) for c in lab)
    roots = {f"_r{k}": big + row[1] * a + row[2] * b for k, row in enumerate(LAB_TO_LMS_ROOT)}
    df = df.withColumns(roots).withColumns({f"_l{k}": F.col(f"_r{k}") * F.col(f"_r{k}") * F.col(f"_r{k}") for k in range(3)})
    return df.withColumns(dict(zip(rgb, apply3(LMS_TO_SRGB, [F.col(f"_l{k}") for k in range(3)])))).drop(*[f"_{p}{k}" for p in "rl" for k in range(3)])


def transfer_table() -> list[int]:
    """Display bytes of 4096 evenly spaced linear values, made by the curve's formula."""
    out = []
    for i in range(TABLE_SIZE):
        c = i / (TABLE_SIZE - 1)
        s = 12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055
        out.append(max(0, min(255, math.floor(255 * s + 0.5))))
    return out


def display_byte(c: Column) -> Column:
    """Table lookup of a linear value, clamped to the table's ends."""
    place = F.least(F.greatest(F.floor(c * F.lit(float(TABLE_SIZE - 1)) + F.lit(0.5)), F.lit(0)), F.lit(TABLE_SIZE - 1))
    return F.element_at(F.lit(transfer_table()), (place + 1).cast("int")).cast("long")


def palette_bytes(palette: DataFrame) -> DataFrame:
    """Q16 l, a, b to r8, g8, b8."""
    wide = palette.withColumns({"_L": dequantised(F.col("l")), "_A": dequantised(F.col("a")), "_B": dequantised(F.col("b"))})
    wide = to_linear_display(wide, ["_L", "_A", "_B"], ["_r", "_g", "_b"])
    return wide.withColumns({"r8": display_byte(F.col("_r")), "g8": display_byte(F.col("_g")), "b8": display_byte(F.col("_b"))}).drop("_L", "_A", "_B", "_r", "_g", "_b")


def delta_squared(one: list[Column], other: list[Column]) -> Column:
    """Integer sum of squared differences."""
    parts = [(x - y) * (x - y) for x, y in zip(one, other)]
    return sum(parts[1:], parts[0])


def delta(one: list[Column], other: list[Column]) -> Column:
    return F.sqrt(delta_squared(one, other))
