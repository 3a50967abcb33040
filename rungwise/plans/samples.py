"""Queries over brackets, mosaics, rungs and pyramids."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rungwise.functions import colour as C
from rungwise.functions import lattice as L
from rungwise.operators import bins as B
from rungwise.operators import exposure as E
from rungwise.operators import indexstats as I
from rungwise.registry import query
from rungwise.sources import views as V

EV = {0: 1.0, 1: 4.0, 2: 16.0, 3: 64.0}
#: Noise profiles (S, O) of the four frames of a bracket (fixed values).
PROFILES = {0: (0.000133622, 9.7885e-07), 1: (0.000257996, 6.53727e-07), 2: (0.000534232, 1.31462e-06), 3: (0.000542475, 1.30951e-06)}
M, R = V.mosaic_sql(), float(V.WHITE - V.BLACK)


def _by_frame(values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col("frame") == k, v) if out is None else out.when(F.col("frame") == k, v)
    return out


def _case(values: dict) -> str:
    return "CASE frame " + " ".join(f"WHEN {k} THEN CAST({v!r} AS DOUBLE)" for k, v in values.items()) + " END"


def observed(spark, d):
    """The mosaic with normalised counts, exposures and noise profiles."""
    m = V.mosaic(spark, d)
    return m.withColumn("y_obs", E.normalised(F.col("dn"), V.BLACK, V.WHITE)).withColumn("e", _by_frame(EV)).withColumn("s", _by_frame({k: v[0] for k, v in PROFILES.items()})).withColumn("o", _by_frame({k: v[1] for k, v in PROFILES.items()}))


OBSERVED = f"""{M},
observed AS (SELECT *, (dn - {V.BLACK}) / CAST({R} AS DOUBLE) AS y_obs, {_case(EV)} AS e, {_case({k: v[0] for k, v in PROFILES.items()})} AS s, {_case({k: v[1] for k, v in PROFILES.items()})} AS o FROM mosaic)"""


@query("prj1_normalise", f"WITH {M} SELECT cycle, frame, y, x, (dn - {V.BLACK}) / CAST({R} AS DOUBLE) AS v FROM mosaic")
def normalise(spark, d):
    m = V.mosaic(spark, d)
    return m.select("cycle", "frame", "y", "x", E.normalised(F.col("dn"), V.BLACK, V.WHITE).alias("v"))


@query("prj2_ev_normalise", f"WITH {OBSERVED} SELECT cycle, frame, y, x, greatest((dn - CAST({V.BLACK} AS DOUBLE)) * (CAST(1 AS DOUBLE) / e / CAST({R} AS DOUBLE)), 0.0) AS v FROM observed")
def ev_normalise(spark, d):
    return observed(spark, d).select("cycle", "frame", "y", "x", E.ev_normalised(F.col("dn").cast("double"), F.col("e"), V.BLACK, V.WHITE).alias("v"))


@query(
    "agg1_relative_exposure",
    f"""WITH {V.EXPOSURES_SQL}, e AS (SELECT *, iso * t / (f_number * f_number) AS e FROM exposures),
w AS (SELECT *, min(e) OVER (PARTITION BY cycle) AS lo, max(e) OVER (PARTITION BY cycle) AS hi, bool_or(t <= 0) OVER (PARTITION BY cycle) AS bad FROM e)
SELECT cycle, frame, t, iso, f_number, CASE WHEN bad OR lo <= 0 OR hi / nullif(lo, 0) <= {E.EQUAL_RATIO} THEN CAST(1 AS DOUBLE) ELSE greatest(1.0, least(256.0, e / nullif(lo, 0))) END AS rel_e FROM w""",
)
def relative_exposure(spark, d):
    return E.relative_exposure(V.exposures(spark, d))


@query(
    "flt6_metadata_validity",
    f"""WITH {V.EXPOSURES_SQL} SELECT cycle, CAST(count(*) AS BIGINT) AS frames, bool_and(t > 0) AS timed,
coalesce(max(iso * t / (f_number * f_number)) / nullif(min(iso * t / (f_number * f_number)), 0) > {E.EQUAL_RATIO}, false) AS spread FROM exposures GROUP BY cycle""",
)
def metadata_validity(spark, d):
    e = F.col("iso") * F.col("t") / (F.col("f_number") * F.col("f_number"))
    rows = V.exposures(spark, d).withColumn("e", e)
    return rows.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("frames"), F.bool_and(F.col("t") > 0).alias("timed"), F.coalesce(F.max("e") / F.nullif(F.min("e"), F.lit(0.0)) > E.EQUAL_RATIO, F.lit(False)).alias("spread")
    )


@query(
    "win7_ratio_to_extremes",
    f"WITH {V.EXPOSURES_SQL} SELECT cycle, frame, iso / min(iso) OVER (PARTITION BY cycle) AS over_min, iso / max(iso) OVER (PARTITION BY cycle) AS over_max FROM exposures",
)
def ratio_to_extremes(spark, d):
    w = Window.partitionBy("cycle")
    return V.exposures(spark, d).select("cycle", "frame", (F.col("iso") / F.min("iso").over(w)).alias("over_min"), (F.col("iso") / F.max("iso").over(w)).alias("over_max"))


WEIGHTS = f"""{OBSERVED},
weighted AS (SELECT *, CASE WHEN y_obs >= 0.98 THEN 0.0 ELSE e * e / (s * greatest(y_obs, 0.0) + o) END AS w,
  greatest(y_obs, 0.0) * greatest(0.0, least((CAST(0.98 AS DOUBLE) - y_obs) / CAST({0.98 - 0.90!r} AS DOUBLE), 1.0)) AS h FROM observed)"""


@query("prj28_likelihood_weight", f"WITH {WEIGHTS} SELECT cycle, frame, y, x, w FROM weighted")
def likelihood_weight(spark, d):
    o = observed(spark, d)
    return o.select("cycle", "frame", "y", "x", E.likelihood_weight(F.col("y_obs"), F.col("e"), F.col("s"), F.col("o")).alias("w"))


@query("prj29_heuristic_weight", f"WITH {WEIGHTS} SELECT cycle, frame, y, x, h AS w FROM weighted")
def heuristic_weight(spark, d):
    return observed(spark, d).select("cycle", "frame", "y", "x", E.heuristic_weight(F.col("y_obs")).alias("w"))


def _fold_sql(weight: str) -> str:
    return f"""list(({weight}) ORDER BY frame) AS ws, list((y_obs / e) ORDER BY frame) AS vs"""


def _fused_sql(weight: str, condition: str, fallback: str) -> str:
    return f"""WITH {WEIGHTS}, g AS (SELECT cycle, y, x, {_fold_sql(weight)}, {fallback} AS fallback FROM weighted GROUP BY cycle, y, x),
f AS (SELECT *, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, len(ws) + 1), lambda i: ws[i] * vs[i])), lambda a, b: a + b) AS num,
  list_reduce(list_prepend(CAST(0 AS DOUBLE), ws), lambda a, b: a + b) AS den FROM g)
SELECT cycle, y, x, CASE WHEN {condition} THEN num / den ELSE fallback END AS fused FROM f"""


@query("agg3_fuse_likelihood", _fused_sql("w", "den > 0", "arg_min(y_obs / e, e)"))
def fuse_likelihood(spark, d):
    return E.fuse_likelihood(observed(spark, d), ["cycle", "y", "x"])


@query("agg2_fuse_heuristic", _fused_sql("h", "den > 1e-8", "min(y_obs / e)"))
def fuse_heuristic(spark, d):
    return E.fuse_heuristic(observed(spark, d), ["cycle", "y", "x"])


@query("jn1_frames_by_place", f"WITH {M} SELECT cycle, y, x, CAST(count(*) AS BIGINT) AS frames, CAST(sum(dn) AS BIGINT) AS total, min(dn) AS least, max(dn) AS most FROM mosaic GROUP BY cycle, y, x")
def frames_by_place(spark, d):
    """Frames meet by grouping on the place, never by joining frame to frame."""
    return V.mosaic(spark, d).groupBy("cycle", "y", "x").agg(F.count(F.lit(1)).alias("frames"), F.sum("dn").alias("total"), F.min("dn").alias("least"), F.max("dn").alias("most"))


@query("flt2_uncensored", f"WITH {OBSERVED} SELECT cycle, frame, y, x, dn FROM observed WHERE y_obs < 0.7")
def uncensored(spark, d):
    return observed(spark, d).filter(F.col("y_obs") < 0.7).select("cycle", "frame", "y", "x", "dn")


@query("flt3_rails", f"WITH {M} SELECT cycle, frame, count(*) FILTER (dn >= 3600) / CAST(count(*) AS DOUBLE) AS clipped, count(*) FILTER (dn < 600) / CAST(count(*) AS DOUBLE) AS below_black FROM mosaic GROUP BY cycle, frame")
def rails(spark, d):
    return E.rails(V.mosaic(spark, d), 3600, 600)


@query(
    "flt7_profile_gate",
    f"WITH {V.EXPOSURES_SQL} SELECT cycle, bool_and(CASE WHEN t > 0.01 THEN iso / 1e6 ELSE 0 END > 0 AND iso > 0) AS likelihood FROM exposures GROUP BY cycle",
)
def profile_gate(spark, d):
    rows = V.exposures(spark, d).withColumn("s", F.when(F.col("t") > 0.01, F.col("iso") / 1e6)).withColumn("o", F.col("iso"))
    return E.with_profiles(rows)


COLOUR = "CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'R' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'B' ELSE 'G' END"


@query("flt1_filter_colour", f"WITH {M} SELECT {COLOUR} AS colour, CAST(count(*) AS BIGINT) AS n, CAST(sum(dn) AS BIGINT) AS total FROM mosaic GROUP BY 1")
def filter_colour(spark, d):
    return V.mosaic(spark, d).groupBy(B.colour_of(F.col("y"), F.col("x")).alias("colour")).agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("total"))


@query("flt13_centre_crop", f"WITH {M} SELECT cycle, frame, y - 8 AS y, x - 8 AS x, dn FROM mosaic WHERE y BETWEEN 8 AND 23 AND x BETWEEN 8 AND 23")
def centre_crop(spark, d):
    side, at = 16, (V.SIDE - 16) // 2 // 2 * 2
    m = V.mosaic(spark, d).filter(F.col("y").between(at, at + side - 1) & F.col("x").between(at, at + side - 1))
    return m.select("cycle", "frame", (F.col("y") - at).alias("y"), (F.col("x") - at).alias("x"), "dn")


def _cell_means_sql(source: str, keys: str, value: str, k: int, extra: str = "") -> str:
    parts = ", ".join(f"CAST(sum({value}) FILTER ({COLOUR} = '{c}') AS DOUBLE) / count(*) FILTER ({COLOUR} = '{c}') AS {c.lower()}" for c in "RGB")
    return f"SELECT {keys}{extra}, y // {k} AS cy, x // {k} AS cx, {parts} FROM {source} GROUP BY ALL"


@query("agg4_cell_means", f"WITH {M} " + _cell_means_sql("mosaic", "cycle, frame", "dn", 4))
def cell_means(spark, d):
    return B.means(B.cell_sums(V.mosaic(spark, d), ["cycle", "frame"], 4, "dn"), ["cycle", "frame"])


LAT = V.lattice_sql(64)


@query("agg7_rung_set", f"WITH {LAT} " + " UNION ALL ".join(_cell_means_sql("lattice", "cycle", "v", 64 // r, f", CAST({r} AS BIGINT) AS rung") for r in (4, 8, 16, 32)))
def rung_set(spark, d):
    return B.rung_set(V.lattice(spark, d), ["cycle"], 64, [4, 8, 16, 32], "v")


@query("agg5_phase_bins", f"WITH {LAT} SELECT cycle, 2 * (y // 4) + y % 2 AS y, 2 * (x // 4) + x % 2 AS x, CAST(sum(v) AS DOUBLE) / count(*) AS v FROM lattice GROUP BY 1, 2, 3")
def phase_bins(spark, d):
    return B.phase_bins(V.lattice(spark, d), ["cycle"], 2, "v")


@query("agg6_box_means", f"WITH {LAT} SELECT cycle, y // 8 AS y, x // 8 AS x, CAST(sum(v) AS DOUBLE) / count(*) AS v FROM lattice GROUP BY 1, 2, 3")
def box_means(spark, d):
    return B.box_means(V.lattice(spark, d), ["cycle"], 8, "v")


@query("prj16_phase_channel", f"WITH {M} SELECT cycle, 2 * (y % 2) + x % 2 AS phase, 4 * frame + 2 * (y % 2) + x % 2 AS channel, CAST(count(*) AS BIGINT) AS n, CAST(sum(dn) AS BIGINT) AS total FROM mosaic GROUP BY 1, 2, 3")
def phase_channel(spark, d):
    return B.phase_planes(V.mosaic(spark, d)).groupBy("cycle", "phase", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("total"))


@query("prj40_phase_planes", f"WITH {M} SELECT cycle, 4 * frame + 2 * (y % 2) + x % 2 AS channel, y // 2 AS py, x // 2 AS px, dn FROM mosaic")
def phase_planes(spark, d):
    return B.phase_planes(V.mosaic(spark, d)).select("cycle", "channel", "py", "px", "dn")


@query("jn8_interleave", f"WITH {M} SELECT cycle, frame, y, x, dn FROM mosaic")
def interleave(spark, d):
    planes = B.phase_planes(V.mosaic(spark, d)).drop("y", "x")
    return B.interleaved(planes).select("cycle", "frame", "y", "x", "dn")


@query("prj41_mosaic_linearity", f"WITH {M} SELECT cycle, y, x, CAST(3 * sum(dn) AS BIGINT) AS v FROM mosaic WHERE frame < 2 GROUP BY cycle, y, x")
def mosaic_linearity(spark, d):
    """Adding two frames and scaling is a union and a sum."""
    m = V.mosaic(spark, d)
    both = m.filter("frame = 0").unionByName(m.filter("frame = 1"))
    return both.withColumn("v", F.col("dn") * 3).groupBy("cycle", "y", "x").agg(F.sum("v").alias("v"))


SIDES = "SELECT DISTINCT 16 * (1 + o_orderkey % 256) AS side FROM orders"


@query("prj19_admissible_rungs", f"WITH s AS ({SIDES}) SELECT side, list_filter([16, 32, 64, 128, 256, 512], lambda r: side % r = 0 AND side // r >= 2 AND (side // r) % 2 = 0) AS rungs FROM s".replace("list_filter([", "list_filter(CAST([").replace("512], lambda", "512] AS BIGINT[]), lambda"))
def admissible_rungs(spark, d):
    s = V.table(spark, d, "orders").select((16 * (1 + F.col("o_orderkey") % 256)).alias("side")).distinct()
    return s.select("side", B.admissible(F.col("side")).alias("rungs"))


@query("prj20_prefix_length", f"WITH s AS ({SIDES}), r AS (SELECT side, list_filter(CAST([16, 32, 64, 128, 256, 512] AS BIGINT[]), lambda r: side % r = 0 AND side // r >= 2 AND (side // r) % 2 = 0) AS rungs FROM s) SELECT side, CAST(coalesce(list_sum(list_transform(list_filter(rungs, lambda r: r <= 128), lambda r: r * r)), 0) AS BIGINT) AS prefix FROM r")
def prefix_length(spark, d):
    s = V.table(spark, d, "orders").select((16 * (1 + F.col("o_orderkey") % 256)).alias("side")).distinct()
    return s.select("side", B.prefix_length(B.admissible(F.col("side")), F.lit(128)).alias("prefix"))


SIZES = "SELECT o_orderkey AS id, 100 + o_orderkey % 5000 AS w, 100 + (o_orderkey * 7) % 4000 AS h FROM orders"


@query(
    "prj17_18_canonical_crop",
    f"""WITH s AS ({SIZES}), c AS (SELECT *, CAST(CASE WHEN least(w, h) >= 2048 THEN 2048 WHEN least(w, h) >= 1024 THEN 1024 WHEN least(w, h) >= 512 THEN 512 WHEN least(w, h) >= 256 THEN 256 END AS BIGINT) AS side FROM s)
SELECT id, side, ((w - side) // 2) // 2 * 2 AS x0, ((h - side) // 2) // 2 * 2 AS y0 FROM c""",
)
def canonical_side(spark, d):
    s = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (100 + F.col("o_orderkey") % 5000).alias("w"), (100 + (F.col("o_orderkey") * 7) % 4000).alias("h"))
    s = s.withColumn("side", L.canonical_side(F.col("w"), F.col("h")))
    return s.select("id", "side", L.crop_origin(F.col("w"), F.col("side")).alias("x0"), L.crop_origin(F.col("h"), F.col("side")).alias("y0"))


# ---------------------------------------------------------------- pyramids

PLANES = f"""{LAT}, planes AS (""" + " UNION ALL ".join(f"SELECT cycle, CAST({r} AS BIGINT) AS rung, y // {64 // r} AS y, x // {64 // r} AS x, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM lattice GROUP BY ALL" for r in (8, 16, 32)) + ")"
STACK = PLANES + """, stack AS (SELECT c.cycle, c.rung, c.y, c.x, c.v - CASE WHEN c.rung = 8 THEN 0 ELSE p.v END AS residual
  FROM planes c LEFT JOIN planes p ON p.cycle = c.cycle AND 2 * p.rung = c.rung AND p.y = c.y // 2 AND p.x = c.x // 2)"""


def planes(spark, d):
    sums = V.lattice(spark, d).groupBy("cycle", F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(F.sum("v").alias("s_v"), F.count("v").alias("n_v"))
    out = None
    for r in (32, 16, 8):
        plane = sums.select("cycle", F.lit(r).cast("long").alias("rung"), F.col("cy").alias("y"), F.col("cx").alias("x"), F.floor(F.col("s_v") / F.col("n_v")).alias("v"))
        out = plane if out is None else out.unionByName(plane)
        sums = B.rolled_up(sums, ["cycle"])
    return out


@query("jn4_residuals", f"WITH {STACK} SELECT * FROM stack")
def residuals(spark, d):
    return B.residuals(planes(spark, d), ["cycle"])


@query("jn5_prefix_decode", f"WITH {PLANES} SELECT cycle, y, x, v FROM planes WHERE rung = 32")
def prefix_decode(spark, d):
    """Decoding the stack gives the plane back exactly."""
    return B.decoded(B.residuals(planes(spark, d), ["cycle"]), ["cycle"], 32, [8, 16, 32])


@query("jn6_upscale", f"WITH {PLANES} SELECT p.cycle, p.y * 4 + dy AS y, p.x * 4 + dx AS x, p.v FROM planes p, range(4) a(dy), range(4) b(dx) WHERE rung = 8")
def upscale(spark, d):
    return B.upscaled(planes(spark, d).filter("rung = 8").drop("rung"), ["cycle"], 4)


@query("jn7_luma_chroma", f"WITH {PLANES} SELECT f.cycle, f.y, f.x, f.v AS luma, c.v AS chroma FROM planes f JOIN planes c ON c.cycle = f.cycle AND f.rung = 32 AND c.rung = 16 AND c.y = f.y // 2 AND c.x = f.x // 2")
def luma_chroma(spark, d):
    p = planes(spark, d)
    fine = p.filter("rung = 32").select("cycle", "y", "x", F.col("v").alias("luma"), F.floor(F.col("y") / 2).alias("py"), F.floor(F.col("x") / 2).alias("px"))
    coarse = p.filter("rung = 16").select("cycle", F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("chroma"))
    return fine.join(coarse, ["cycle", "py", "px"]).select("cycle", "y", "x", "luma", "chroma")


@query("jn17_disagreement", f"WITH {PLANES} SELECT f.cycle, CAST(sum(abs(f.v - c.v)) AS BIGINT) AS total, CAST(max(abs(f.v - c.v)) AS BIGINT) AS most FROM planes f JOIN planes c ON c.cycle = f.cycle AND f.rung = 32 AND c.rung = 8 AND c.y = f.y // 4 AND c.x = f.x // 4 GROUP BY f.cycle")
def disagreement(spark, d):
    p = planes(spark, d)
    coarse = B.upscaled(p.filter("rung = 8").drop("rung"), ["cycle"], 4).withColumnRenamed("v", "c")
    both = p.filter("rung = 32").join(coarse, ["cycle", "y", "x"])
    return both.groupBy("cycle").agg(F.sum(F.abs(F.col("v") - F.col("c"))).alias("total"), F.max(F.abs(F.col("v") - F.col("c"))).alias("most"))


@query("agg13_detail_energy", f"WITH {STACK} SELECT cycle, y * 4 // rung AS y, x * 4 // rung AS x, CAST(sum(abs(residual)) AS BIGINT) AS energy FROM stack WHERE rung > 8 GROUP BY 1, 2, 3")
def detail_energy(spark, d):
    return B.detail_energy(B.residuals(planes(spark, d), ["cycle"]), ["cycle"], 4)


@query("set1_levels", f"WITH {PLANES} SELECT rung, CAST(count(*) AS BIGINT) AS places, CAST(sum(v) AS BIGINT) AS total FROM planes GROUP BY rung")
def levels(spark, d):
    return planes(spark, d).groupBy("rung").agg(F.count(F.lit(1)).alias("places"), F.sum("v").alias("total"))


@query("set2_bitwise_equal", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra")
def bitwise_equal(spark, d):
    """A plane and its decoded copy differ in no row, either way."""
    p = planes(spark, d)
    again = B.decoded(B.residuals(p, ["cycle"]), ["cycle"], 32, [8, 16, 32])
    own = p.filter("rung = 32").select("cycle", "y", "x", "v")
    missing, extra = own.exceptAll(again).agg(F.count(F.lit(1)).alias("missing")), again.exceptAll(own).agg(F.count(F.lit(1)).alias("extra"))
    return missing.crossJoin(extra)  # one row each


@query("jn18_replay_differences", f"WITH {PLANES} SELECT CAST(count(*) AS BIGINT) AS places, CAST(count(*) FILTER (a.v = b.v) AS BIGINT) AS same FROM planes a JOIN planes b ON a.cycle = b.cycle AND a.rung = 32 AND b.rung = 32 AND b.y = a.x AND b.x = 31 - a.y")
def replay_differences(spark, d):
    """A plane against its quarter turn."""
    p = planes(spark, d).filter("rung = 32")
    y, x = L.rotated(F.col("y"), F.col("x"), 32)
    turned = p.select("cycle", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("v").alias("w")).select("cycle", F.col("y0").alias("y"), F.col("x0").alias("x"), "w")
    moved = p.select("cycle", y.alias("y"), x.alias("x"), "v")
    return moved.join(turned, ["cycle", "y", "x"]).agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("v") == F.col("w")).alias("same"))


@query("prj21_quarter_turn", f"WITH {LAT} SELECT cycle, x AS y, 63 - y AS x, v FROM lattice")
def quarter_turn(spark, d):
    y, x = L.rotated(F.col("y"), F.col("x"), 64)
    return V.lattice(spark, d).select("cycle", y.alias("y"), x.alias("x"), "v")


@query("fused_rung_balance", f"WITH {OBSERVED}, fused AS (" + _fused_sql("w", "den > 0", "arg_min(y_obs / e, e)").split(f"WITH {WEIGHTS}, ")[1].join(["SELECT cycle, y, x, fused FROM (WITH weighted AS (SELECT *, CASE WHEN y_obs >= 0.98 THEN 0.0 ELSE e * e / (s * greatest(y_obs, 0.0) + o) END AS w FROM observed), ", ")"]) + """),
codes AS (SELECT cycle, y // 2 AS cy, x // 2 AS cx, max(CAST(floor(fused * 65536 + 0.5) AS BIGINT)) % 256 AS idx FROM fused GROUP BY 1, 2, 3),
c AS (SELECT cycle, idx, count(*) AS c FROM codes GROUP BY 1, 2)
SELECT cycle, CAST(sum(c) AS BIGINT) AS n, CAST(256 * sum(c * c) - sum(c) * sum(c) AS DOUBLE) / sum(c) AS chi2 FROM c GROUP BY cycle""")
def fused_rung_balance(spark, d):
    """Brackets fused, binned to a rung, quantised, and the balance of the codes per cycle."""
    fused = E.fuse_likelihood(observed(spark, d), ["cycle", "y", "x"])
    codes = fused.groupBy("cycle", F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg((F.max(C.quantised(F.col("fused"))) % 256).alias("idx"))
    return I.balance(codes, ["cycle"]).select("cycle", "n", "chi2")
