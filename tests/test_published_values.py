"""Operators against published results.

The inputs follow published rules (a linear congruential sequence, a palette
rule); the results are short tables or SHA-256 digests of longer ones, taken
as fixed values.
"""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.functions import colour as C
from rungwise.operators import bins as B
from rungwise.operators import exposure as E
from rungwise.operators import indexstats as I
from rungwise.operators import palette as P
from rungwise.operators import sequential as Q
from rungwise.operators import wire as W
from rungwise.plans import files


def sequence(seed, count):
    """States over unbounded integers, the seed first."""
    out = []
    for _ in range(count):
        out.append(seed)
        seed = seed * files.LCG_STEP + files.LCG_PLUS
    return out


def low_bits(seed, count, modulus):
    """(state div 65536) mod a power of two, from the low bits alone."""
    out = []
    for _ in range(count):
        out.append(seed // 65536 % modulus)
        seed = (seed * files.LCG_STEP + files.LCG_PLUS) % (1 << 64)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_error_diffusion(spark):
    palette = np.array([[r["l"], r["a"], r["b"]] for r in files.q16_bell(spark).orderBy("idx").collect()])
    jitter = np.array([s // 65536 % 4001 - 2000 for s in sequence(7, 768)]).reshape(256, 3)
    idx, dropped = Q.diffuse(palette, palette + jitter, 16, 2)
    assert dropped.tolist() == [18840, 5577, 3652]
    assert sha(bytes(idx.tolist())) == "cd1080844eca79d2651bafcfeed0394a1f068a9e1a97e99b059fba0d02e318e1"


def test_balance_of_sequences(spark):
    rows = [(4096, i) for i in low_bits(7, 4096, 256)] + [(65536, i) for i in low_bits(9, 65536, 256)] + [(256, 0)] * 256 + [(255, i) for i in range(256)]
    got = {r["k"]: r["chi2"] for r in I.balance(spark.createDataFrame(rows, "k long, idx long"), ["k"]).collect()}
    assert got == {4096: 240.875, 65536: 248.9453125, 256: 65280.0, 255: 0.0}
    used = {(r["k"], r["idx"]): r["n"] for r in I.usage(spark.createDataFrame(rows, "k long, idx long"), ["k"]).collect()}
    assert sha(struct.pack("<256H", *[used[65536, i] for i in range(256)])) == "692c3320e2c338ca2ccb3f495dc705000c4ee6b963d1114a9cec591cd5919a83"


def test_transfer_table():
    assert sha(bytes(C.transfer_table())) == "293d68ade763245e632a69aa4fb63b9b579548e5c5cd7cb741add7ba2579c06e"


def test_encoded_image(spark):
    table = files.table_bytes(spark)
    assert sha(table) == "8d004e889d4588a037a3d1e2f769133cdad8ac09fb87ccdf91687f4552bea0a3"
    frames = [np.arange(256), np.array(low_bits(41, 256, 256))]
    data = W.encode(16, 20, table, [W.frame_data(f) for f in frames])
    assert len(data) == 1429 and sha(data) == "ee2184702e261e0f457a66491ff9056757084c403e89e19a2b208d70c5ad27cd"


def test_likelihood_fusion(spark):
    """Observations of a dyadic scene by four exposures, without noise; the longer ones censored where they clip."""
    profiles = [(0.000133622, 9.7885e-07), (0.000257996, 6.53727e-07), (0.000534232, 1.31462e-06), (0.000542475, 1.30951e-06)]
    scene = [v / 4096 for v in low_bits(4242, 256, 4096)]
    rows = [(i, k, e * x, e, *profiles[k]) for i, x in enumerate(scene) for k, e in enumerate((1.0, 4.0, 16.0, 64.0))]
    df = spark.createDataFrame(rows, "place long, frame long, y double, e double, s double, o double").withColumnRenamed("y", "y_obs")
    got = E.fuse_likelihood(df, ["place"], clip=0.98).orderBy("place").collect()
    assert sha(struct.pack("<256d", *[r["fused"] for r in got])) == "3718cc36b20e4cdb53e5d703397ad222a20a98fa6f0e535afc366c0272dcf858"


def test_phase_bins(spark):
    values = low_bits(24601, 64 * 64, 4096)
    df = spark.createDataFrame([(0, k // 64, k % 64, v / 4096) for k, v in enumerate(values)], "cycle long, y long, x long, v double")
    got = B.phase_bins(df, ["cycle"], 2, "v").orderBy("y", "x").collect()
    assert sha(struct.pack("<1024d", *[r["v"] for r in got])) == "279150295ce20082f0b7f768acf6e713d3f11e3d6b0346c952823213c5905b66"


def test_cell_means(spark):
    values = [s // 65536 % 16383 for s in sequence(5, 64)]
    df = spark.createDataFrame([(0, k // 8, k % 8, v / 128) for k, v in enumerate(values)], "cycle long, y long, x long, v double")
    got = B.means(B.cell_sums(df, ["cycle"], 4, "v"), ["cycle"]).orderBy("cy", "cx").collect()
    assert [r["r"] for r in got] == [25.359375, 51.1171875, 73.46484375, 59.544921875]
    assert [r["g"] for r in got] == [71.8388671875, 70.439453125, 58.1533203125, 61.7529296875]
    assert [r["b"] for r in got] == [75.787109375, 70.26953125, 62.33984375, 76.69140625]


@pytest.mark.parametrize(
    "frames, want",
    [
        ([(1 / 250, 100, 1.78), (1 / 60, 100, 1.78), (1 / 15, 200, 1.78), (1 / 8, 400, 1.78)], [1.0, 25 / 6, 100 / 3, 125.0]),
        ([(1 / 256, 100, 2), (1 / 64, 100, 2), (1 / 16, 100, 2), (1 / 4, 100, 2)], [1.0, 4.0, 16.0, 64.0]),
        ([(1 / 1024, 100, 2), (1 / 60, 100, 2), (1 / 30, 100, 2), (1.0, 100, 2)], [1.0, 256 / 15, 512 / 15, 256.0]),
        ([(0.0, 100, 2), (1 / 60, 100, 1.78), (1 / 15, 200, 1.78), (1 / 8, 400, 1.78)], [1.0] * 4),
        ([(1 / 60, 100, 2)] * 4, [1.0] * 4),
    ],
)
def test_relative_exposures(spark, frames, want):
    df = spark.createDataFrame([(0, k, float(t), float(iso), float(f)) for k, (t, iso, f) in enumerate(frames)], "cycle long, frame long, t double, iso double, f_number double")
    got = [r["rel_e"] for r in E.relative_exposure(df).orderBy("frame").collect()]
    assert got == pytest.approx(want, rel=1e-12)


def test_bell_allocation(spark):
    got = [r["L"] for r in P.bell_palette(spark).orderBy("idx").collect()]
    assert got[:4] == [0.0, 0.09375, 0.140625, 0.171875] and got[255] == 1.0 and got == sorted(got)
    seed = P.seed_palette(spark).orderBy("idx").select(F.col("L"), F.col("A"), F.col("B")).limit(4).collect()
    assert [tuple(r) for r in seed] == [pytest.approx(x, abs=1e-9) for x in ((0.15, 0.1, 0.0), (0.15, 0.09238795325112868, 0.03826834323650898), (0.15, 0.07071067811865475, 0.07071067811865475), (0.15, 0.03826834323650899, 0.09238795325112868))]
