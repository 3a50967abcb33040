"""Algebraic laws and fixed points of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rungwise.functions import colour as C
from rungwise.functions import lattice as L
from rungwise.operators import bins as B
from rungwise.operators import exposure as E
from rungwise.operators import indexstats as I
from rungwise.operators import palette as P
from rungwise.operators import sequential as Q
from rungwise.operators import statistics as S
from rungwise.operators import temporal as T
from rungwise.operators import wire as W
from rungwise.sources import packages as K
from rungwise.sources import rawfile as R
from rungwise.streaming import operators as O
from rungwise.streaming.run import appended


def test_cube_roots_cube_back(spark):
    x = [0.0, 1e-9, 0.125, 1.0, 2.0, 3.7, 1000.0, -8.0, 0.9999999999999999]
    got = C.with_cube_roots(spark.createDataFrame([(v,) for v in x], "v double"), ["v"]).toPandas()["v"]
    assert np.allclose(got**3, x, rtol=1e-14)
    assert got[7] == -2.0 and got[3] == 1.0 and got[0] == 0.0


def test_white_is_neutral_and_camera_law_holds():
    assert C.inv3([[1, 2, 3], [2, 4, 6], [0, 0, 1]]) is None
    forward, neutral = [[0.6, 0.3, 0.1], [0.2, 0.7, 0.1], [0.0, 0.1, 0.7]], [0.4, 1.0, 0.5]
    assert C.camera_matrix(neutral) is None
    assert C.camera_matrix(neutral, forward1=forward, colour2=forward) == C.camera_by_forward(forward, neutral)
    colour = [[0.9, -0.3, -0.1], [-0.4, 1.3, 0.1], [-0.1, 0.2, 0.5]]
    assert C.neutral_spread(C.camera_by_colour(colour, neutral), neutral) < 1e-6


def test_display_bytes_of_grey(spark):
    grey = spark.createDataFrame([(i, int(65536 * v), 0, 0) for i, v in enumerate((0.0, 0.5, 1.0))], "idx long, l long, a long, b long")
    got = C.palette_bytes(grey).orderBy("idx").toPandas()[["r8", "g8", "b8"]].to_numpy()
    assert (got[0] == 0).all() and (got[2] == 255).all() and (np.ptp(got[1]) <= 1)
    table = C.transfer_table()
    assert len(table) == 4096 and table == sorted(table) and table[0] == 0 and table[-1] == 255


def frames(rows):
    return [(0, i, t, iso, 1.78) for i, (t, iso) in enumerate(rows)]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1.0, 100.0), (4.0, 100.0), (16.0, 100.0), (64.0, 100.0)], [1.0, 4.0, 16.0, 64.0]),
        ([(1.0, 100.0), (1.02, 100.0)], [1.0, 1.0]),
        ([(0.0, 100.0), (4.0, 100.0)], [1.0, 1.0]),
        ([(1.0, 100.0), (1024.0, 100.0)], [1.0, 256.0]),
    ],
)
def test_relative_exposure(spark, rows, want):
    got = E.relative_exposure(spark.createDataFrame(frames(rows), "cycle long, frame long, t double, iso double, f_number double"))
    assert got.orderBy("frame").toPandas()["rel_e"].tolist() == want


def test_fusion_gives_back_noise_free_scenes_and_falls_back(spark):
    scene = [k / 4096 for k in (0, 1, 50, 900, 4000)] + [1.5]
    rows = [(i, k, e * x, float(e), 1e-4, 1e-6) for i, x in enumerate(scene) for k, e in enumerate((1, 4, 16, 64))]
    df = spark.createDataFrame(rows, "i long, frame long, y_obs double, e double, s double, o double")
    for fuse in (E.fuse_likelihood, E.fuse_heuristic):
        got = fuse(df, ["i"]).orderBy("i").toPandas()["fused"]
        assert np.allclose(got, scene, atol=1e-12)


def lattice(spark, side, seed=1):
    v = np.random.default_rng(seed).integers(0, 4096, (side, side))
    return v, spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(side) for x in range(side)], "cycle long, y long, x long, v long")


def test_rolled_up_rungs_equal_direct_ones_and_phase_bins_keep_means(spark, same):
    _, df = lattice(spark, 32)
    rolled = B.rung_set(df, ["cycle"], 32, [4, 8, 16], "v").filter("rung = 4").drop("rung")
    direct = B.means(B.cell_sums(df, ["cycle"], 8, "v"), ["cycle"])
    same(rolled.toPandas(), direct.toPandas())
    binned = B.phase_bins(df, ["cycle"], 2, "v")
    coarse = B.means(B.cell_sums(binned, ["cycle"], 4, "v"), ["cycle"])
    both = coarse.join(direct.select("cy", "cx", *[F.col(c).alias(f"d{c}") for c in "rgb"]), ["cy", "cx"]).toPandas()
    assert np.allclose(both[["r", "g", "b"]], both[["dr", "dg", "db"]])


def test_residual_stack_decodes_at_every_rung(spark, same):
    planes = None
    for r in (4, 8, 16):
        _, df = lattice(spark, r, r)
        plane = df.withColumn("rung", F.lit(r).cast("long")).select("cycle", "rung", "y", "x", "v")
        planes = plane if planes is None else planes.unionByName(plane)
    stack = B.residuals(planes, ["cycle"])
    for r in (4, 8, 16):
        same(B.decoded(stack, ["cycle"], r, [4, 8, 16]).toPandas(), planes.filter(F.col("rung") == r).drop("rung").toPandas())


def test_phase_planes_interleave_back(spark, same):
    _, df = lattice(spark, 8)
    df = df.withColumn("frame", F.lit(2).cast("long"))
    same(B.interleaved(B.phase_planes(df).drop("y", "x")).select(*df.columns).toPandas(), df.toPandas())


def test_keys_are_bijections(spark):
    df = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x"))
    y, x = F.col("y"), F.col("x")
    for key in (L.patch_key(y, x), L.serpentine_key(y, x, 64)):
        assert df.select(key.alias("k")).distinct().count() == 4096
    turned = df
    for _ in range(4):
        a, b = L.rotated(F.col("y"), F.col("x"), 64)
        turned = turned.select(a.alias("y"), b.alias("x"))
    assert turned.exceptAll(df).count() == 0


def test_neighbours_stay_neighbours_on_the_tesseract(spark):
    rows = [(r, g, b, t) for r in range(4) for g in range(4) for b in range(4) for t in range(4)]
    df = spark.createDataFrame(rows, "r long, g long, b long, t long")
    v, u = L.tesseract_place(*[F.col(c) for c in "rgbt"])
    at = {(x["v"], x["u"]): x[:4] for x in df.select("r", "g", "b", "t", v.alias("v"), u.alias("u")).collect()}
    assert len(at) == 256
    for (a, b), c in at.items():
        for other in ((a + 1, b), (a, b + 1)):
            if other in at:
                assert sum(abs(p - q) for p, q in zip(c, at[other])) == 1


@given(st.integers(-(10**7), 10**7))
@settings(max_examples=60, deadline=None)
def test_error_shares_are_exact(e):
    floor = [(k * e) >> 4 for k in (7, 3, 5, 1)]
    assert floor[0] + (e - sum(floor)) + sum(floor[1:]) == e


def test_balance_of_equal_and_single_use(spark):
    rows = [(0, i % 256) for i in range(1024)] + [(1, 7)] * 256
    got = {r["k"]: r for r in I.balance(spark.createDataFrame(rows, "k long, idx long"), ["k"]).collect()}
    assert got[0]["chi2"] == 0.0 and got[0]["entropy"] == pytest.approx(8.0)
    assert got[1]["chi2"] == 255.0 * 256 and got[1]["entropy"] == 0.0
    assert I.usage(spark.createDataFrame(rows, "k long, idx long"), ["k"]).count() == 512


def test_window_of_full_radius_is_the_nearest_search(spark, same):
    pal = P.bell_palette(spark).select("idx", *[C.quantised(F.col(c)).alias(c.lower()) for c in ("L", "A", "B")])
    sites = spark.range(256).select(F.floor(F.col("id") / 16).alias("y"), (F.col("id") % 16).alias("x"), (F.col("id") * 251 % 65536).alias("l"), (F.col("id") * 17 - 2000).alias("a"), (F.col("id") * 13 - 1500).alias("b"))
    near = P.nearest(sites.withColumn("pos", F.col("y") * 16 + F.col("x")), pal).select("y", "x", "idx", "d2")
    same(P.window_choice(sites, pal, 16, 15).toPandas(), near.toPandas())


def test_walk_serves_the_palette_itself_and_conserves():
    rng = np.random.default_rng(2)
    pal = np.stack([np.arange(256) * 200, rng.integers(-3000, 3000, 256), rng.integers(-3000, 3000, 256)], axis=1)
    idx, dropped = Q.diffuse(pal, pal.copy(), 16, 2)
    assert idx.tolist() == list(range(256)) and not dropped.any()
    target = pal + rng.integers(-2000, 2000, pal.shape)
    idx, dropped = Q.diffuse(pal, target, 16, 2)
    assert (target.sum(0) - pal[idx].sum(0) == dropped).all()


def plain_settle(idx, moves, options, ceiling):
    """One candidate after the other, the balance counted anew each time."""
    idx, done, paid = list(idx), set(), 0.0
    fair = len(idx) / options
    chi2 = lambda x: sum((x.count(o) - fair) ** 2 for o in range(options)) / fair
    for cost, i, q in moves:
        if chi2(idx) <= ceiling:
            break
        other = [*idx[:i], q, *idx[i + 1 :]]
        if i not in done and chi2(other) < chi2(idx) - 1e-9:
            idx, paid = other, paid + max(cost, 0.0)
            done.add(i)
    return idx, chi2(idx), len(done), paid


@given(st.lists(st.integers(0, 7), min_size=8, max_size=40), st.lists(st.tuples(st.floats(-1, 5), st.integers(0, 39), st.integers(0, 7)), max_size=60), st.sampled_from([0.0, 3.0, 9.0]))
@settings(max_examples=60, deadline=None)
def test_settle_is_the_plain_loop(idx, moves, ceiling):
    moves = sorted(m for m in moves if m[1] < len(idx))
    cost, site, to = (np.array(x, t) for x, t in zip(zip(*moves) if moves else ((), (), ()), (float, np.int64, np.int64)))
    got, report = Q.settle(np.array(idx, np.int64), cost, site, to, n_options=8, ceiling=ceiling, scan=7)
    want, after, n, paid = plain_settle(idx, moves, 8, ceiling)
    assert got.tolist() == want and report["moves"] == n
    assert report["after"] == pytest.approx(after) and report["paid"] == pytest.approx(paid)


def test_map_steps_follow_the_weighted_means():
    """One step in plain loops: softmax over distance, spread over the grid, means of what arrives."""
    rng = np.random.default_rng(6)
    palette, targets = rng.normal(size=(256, 3)), rng.normal(size=(20, 3))
    d2 = np.array([[sum((t - p) ** 2) for p in palette] for t in targets])
    w = np.exp(-d2 / (0.05 * d2.mean()))
    w /= w.sum(1, keepdims=True)
    want = palette.copy()
    for k in range(0, 256, 17):
        r = [sum(w[t, j] * math.exp(-((j // 16 - k // 16) ** 2 + (j % 16 - k % 16) ** 2) / 4.5) for j in range(256)) for t in range(20)]
        want[k] += 0.5 * sum(r) / (sum(r) + 1) * (np.dot(r, targets) / sum(r) - palette[k])
    got = Q.refine_map(palette, targets, steps=1)
    assert np.allclose(got[::17], want[::17], atol=1e-6)


def test_network_has_no_activation_after_fuse_and_head():
    one = lambda out, size, into: np.ones((out, size, size, into))
    tensors = {"encoder.stem.weight": -one(4, 3, 1), "encoder.fuse.weight": one(2, 1, 4), "encoder.ladder.0.weight": one(2, 3, 2), "palette.weight": -one(3, 1, 2)}
    layers = Q.seed_layers(tensors)
    assert [(s, g, a) for _, _, s, g, a in layers] == [(1, 4, True), (1, 1, False), (2, 1, True), (1, 1, False)]
    x = np.zeros((4, 4, 4))
    x[:, 1, 1] = 16.0
    # stem -16 at nine places of each channel, leaky -1; fuse -4; each halved site sees four of the places in two channels,
    # -32, leaky -2; the head sums two channels and turns the sign
    assert Q.forward(x, layers).tolist() == np.full((3, 2, 2), 4.0).tolist()


def test_ordering_over_one_key_and_many(spark):
    from pyspark.sql import Window

    from rungwise.operators import ordering as O

    rows = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 3 - 1)).alias("k"), (F.col("id") * 7919 % 1013).alias("v"), "id").withColumn("k", F.when(F.col("k") != 2, F.col("k")))
    w = Window.partitionBy("k").orderBy("v", "id")
    want = rows.withColumn("_r", F.row_number().over(w).cast("long") - 1).withColumn("_n", F.count("*").over(Window.partitionBy("k")))
    assert O.ranked(rows, ["k"], ["v", "id"]).exceptAll(want).count() == 0
    most = rows.withColumn("m", F.max("id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert O.running_max(rows, ["k"], ["v", "id"], "id", "m").exceptAll(most).count() == 0
    for n in (2, 32, 900):
        trail = rows.withColumn("lo", F.min("id").over(w.rowsBetween(-(n - 1), 0)))
        assert O.trailing(rows, ["k"], ["v", "id"], n, lambda x: {"lo": F.min("id").over(x)}).exceptAll(trail).count() == 0
    assert O.ranked(rows.limit(0), ["k"], ["v"]).count() == 0 and O.picked(rows, [], ["id"], lambda n: F.array(n - 1)).first()["id"] == 2999


@given(st.lists(st.integers(0, 255), max_size=700))
@settings(max_examples=25, deadline=None)
def test_wire_round_trip_and_length(values):
    data = W.frame_data(np.array(values, np.int64))
    blocks, at = b"", 1
    while data[at]:
        blocks += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    assert W.decode_codes(W.unpack_codes(blocks)).tolist() == values
    n = len(values)
    chunks = max(1, (n + 253) // 254)
    payload = (9 * (1 + n + chunks) + 7) // 8
    assert len(data) == 1 + payload + (payload + 254) // 255 + 1


def test_images_that_are_none_are_refused():
    with pytest.raises(ValueError):
        W.decode(b"PNG" * 400)


@pytest.mark.parametrize("how", [{}, {"compression": 7}, {"compression": 7, "tile": 8}, {"order": ">"}])
def test_raw_round_trip(how):
    s = (528 + np.arange(20 * 12) * 13 % 3000).reshape(12, 20).astype(np.uint16)
    got = R.decode(R.build(s, **how))
    assert (got["samples"] == s).all() and got["iso"] == 100.0 and got["noise_s"] == 1e-4


@pytest.mark.parametrize(
    "data, status",
    [
        (b"", "SHORT_READ"), (b"XX" + b"\0" * 20, "UNSUPPORTED_BYTE_ORDER"), (b"II" + b"\0" * 20, "BAD_TIFF_MAGIC"), (None, "NULL_POINTER"),
        (R.build(np.zeros((4, 4), np.uint16), compression_tag=8), "UNSUPPORTED_COMPRESSION_DEFLATE"), (R.build(np.zeros((4, 4), np.uint16), bits=10), "UNSUPPORTED_BIT_DEPTH"),
        (R.build(np.zeros((4, 4), np.uint16), cfa=[1, 0, 2, 1]), "UNSUPPORTED_CFA_PATTERN"), (R.build(np.zeros((4, 4), np.uint16))[:-4], "SHORT_READ"),
    ],
)
def test_raw_statuses(spark, data, status):
    df = spark.createDataFrame([("a", bytearray(data) if data is not None else None)], "path string, content binary")
    row = R.decoded(df).first()
    assert (row["status_name"], row["samples"]) == (status, None)


def test_predictor_seven_round_trip():
    s = np.random.default_rng(3).integers(0, 4096, (9, 14))
    assert (R.decode_ljpeg(R.encode_ljpeg(s, predictor=7)) == s).all()


def test_checksum_and_weights():
    assert f"{K.crc64(b'123456789'):016x}" == "995dc9bbdf1939fa"
    config, got = K.parse_weights(K.build_weights({"b": np.ones((2, 2)), "a": np.arange(3)}, {"d": 1}))
    assert config == {"d": 1, "tensors": 2} and [n for n, _, _ in got] == ["a", "b"]
    with pytest.raises(ValueError, match="BAD_MAGIC"):
        K.parse_weights(b"\0" * 40)


def test_medians_and_deciles(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 3.0, 4.0)], "k long, v double")
    assert T.upper_median(df, ["k"], "v", "m").first()["m"] == 3.0
    assert S.ordered_pick(df, ["k"], "v", 0.5, "p").first()["p"] == 3.0
    assert [r["value"] for r in T.deciles(df, ["k"], "v").orderBy("decile").collect()] == [1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0, 4.0, 4.0]


def test_steady_cycles_have_no_alias_and_no_gain(spark):
    rows = [(0, f, float(4**f), y, x, 100 + (y // 4) * 10 + x // 4) for f in range(4) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "cycle long, frame long, ev double, y long, x long, v long")
    per, gain, sigma = T.cycle_statistics(df, 16, 4, 2)
    assert gain.first()["gain"] == 0.0 and per.agg(F.max("d")).first()[0] == 0.0 and sigma.count() == 4


def test_convolution_of_an_impulse_is_the_kernel():
    x = np.zeros((1, 5, 5))
    x[0, 2, 2] = 1
    w = np.arange(9.0).reshape(1, 1, 3, 3)
    assert (Q.conv2d(x, w, np.zeros(1))[0, 1:4, 1:4] == w[0, 0, ::-1, ::-1]).all()
    assert Q.leaky(np.array([-16.0, 2.0])).tolist() == [-1.0, 2.0]


def test_streams_do_not_depend_on_micro_batches(spark, tmp_path, same):
    rows = [(i % 3, i, i * 10, (i * 7) % 11, i % 4 != 0) for i in range(60)]
    schema = "series long, pos long, us long, idx long, ok boolean"
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    runs = []
    for n in (1, 100):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(str(tmp_path / "in"))
        runs.append([appended(f(s), "t").toPandas() for f in (
            lambda s: O.throttled(s, "series", "us", "pos", 55), lambda s: O.monotone(s, "series", "us", "pos"), lambda s: O.brackets(s, "series", "us", "pos", "idx"), lambda s: O.running_churn(s, "series", "us", "pos", "idx"),
        )])
    for a, b in zip(*runs):
        same(a, b)
