"""Keys and closed forms on square lattices, all integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 16
LARGEST_SIDE = 2048
SMALLEST_SIDE = 256
CLEAR_GROUP = 254
BLOCK = 255


def whole(a: Column, b) -> Column:
    return F.floor(a / b)


def canonical_side(w: Column, h: Column) -> Column:
    """Largest 256 * 2^j within both sides, at most 2048; null below 256."""
    least = F.least(w, h)
    out = F.when(least >= LARGEST_SIDE, LARGEST_SIDE)
    side = LARGEST_SIDE // 2
    while side >= SMALLEST_SIDE:
        out = out.when(least >= side, side)
        side //= 2
    return out.cast("long")


def crop_origin(dim: Column, side: Column) -> Column:
    """Centre origin, snapped down to even."""
    return whole(whole(dim - side, 2), 2) * 2


def rotated(y: Column, x: Column, side) -> tuple[Column, Column]:
    """Where a site goes in a clockwise quarter turn."""
    return x, side - 1 - y


def patch_key(y: Column, x: Column) -> Column:
    """Order by 16 by 16 patches, then inside the patch."""
    return (whole(y, GRID) * GRID + whole(x, GRID)) * 256 + (y % GRID) * GRID + x % GRID


def patch_place(key: Column) -> tuple[Column, Column]:
    patch, inner = whole(key, 256), key % 256
    return whole(patch, GRID) * GRID + whole(inner, GRID), (patch % GRID) * GRID + inner % GRID


def serpentine_key(y: Column, x: Column, side) -> Column:
    return y * side + F.when(y % 2 == 0, x).otherwise(side - 1 - x)


def home(y: Column, x: Column, side) -> tuple[Column, Column]:
    return whole(y * GRID, side), whole(x * GRID, side)


def snake(high: Column, low: Column) -> Column:
    """A base-4 digit that runs back and forth with the one above it."""
    return F.when(high % 2 == 0, low).otherwise(3 - low)


def tesseract_place(r: Column, g: Column, b: Column, t: Column) -> tuple[Column, Column]:
    """Four base-4 coordinates to a 16 by 16 grid, neighbours staying neighbours."""
    return 4 * r + snake(r, g), 4 * b + snake(b, t)


def tesseract_of(v: Column, u: Column) -> tuple[Column, Column, Column, Column]:
    r, b = whole(v, 4), whole(u, 4)
    return r, snake(r, v % 4), b, snake(b, u % 4)


def frame_data_length(n: Column) -> Column:
    """Bytes that a frame of n indices takes on the wire."""
    chunks = F.greatest(F.lit(1).cast("long"), whole(n + CLEAR_GROUP - 1, CLEAR_GROUP))
    codes = 1 + n + (chunks - 1) + 1
    data = whole(9 * codes + 7, 8)
    return 1 + data + whole(data + BLOCK - 1, BLOCK) + 1


def encoded_length(side: Column, frames: Column) -> Column:
    """Bytes of a whole animated image: header, table, loop, frames, trailer."""
    return 6 + 7 + 768 + 19 + frames * (8 + 10 + frame_data_length(side * side)) + 1


def swap_delta(c_from: Column, c_to: Column, n: Column) -> Column:
    """Change of the balance statistic when one site moves between options."""
    return F.lit(512.0) * (c_to - c_from + 1) / n


def error_shares(e: Column) -> list[Column]:
    """7, 3, 5 and 1 sixteenths, floored; the remainder goes with the first."""
    parts = [F.shiftright(k * e, 4) for k in (7, 3, 5, 1)]
    return [parts[0] + (e - (parts[0] + parts[1] + parts[2] + parts[3])), *parts[1:]]


def bin_index(v: Column, n: int) -> Column:
    """Fixed bins over [0, 1], ends clamped."""
    clamped = F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))
    return F.least(F.floor(clamped * F.lit(float(n))), F.lit(n - 1).cast("long"))


def bin_centre(i: Column, n: int) -> Column:
    return (i + F.lit(0.5)) / F.lit(float(n))


def room_stops(level: Column, target: float, most: float = 5.0) -> Column:
    """Stops from a level to a target, clamped."""
    return F.greatest(F.lit(-most), F.least(F.log2(F.lit(target) / F.greatest(level, F.lit(1e-4))), F.lit(most)))
