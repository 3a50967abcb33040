"""Queries over bundles, logs, reference rungs and soft palettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rungwise.functions import colour as C
from rungwise.operators import bins as B
from rungwise.operators import demosaic as D
from rungwise.operators import exposure as E
from rungwise.operators import sequential as Q
from rungwise.plans import files as PF
from rungwise.plans import samples as PS
from rungwise.plans.colour import oklab_sql
from rungwise.registry import query
from rungwise.sources import bundles as U
from rungwise.sources import rawfile as R
from rungwise.sources import views as V
from rungwise.streaming.run import shared_path


@query("snk5_cycle_bundle", f"WITH {PS.PLANES} SELECT cycle, rung, y, x, v FROM planes")
def cycle_bundle(spark, d):
    """Planes written as a bundle by cycle and rung, read back."""
    path = shared_path(spark, "bundle")
    U.write({"planes": PS.planes(spark, d)}, path, ["cycle", "rung"])
    got = spark.read.parquet(f"{path}/planes")
    return got.select(F.col("cycle").cast("long").alias("cycle"), F.col("rung").cast("long").alias("rung"), "y", "x", "v")


@query("snk6_burst_bundle", "SELECT true AS intact")
def burst_bundle(spark, d):
    """Index frames written by burst; the manifest vouches for every file."""
    path = shared_path(spark, "burst")
    frames = PF.index_frames(spark, d).withColumn("burst", F.floor(F.col("cycle") / 16))
    U.write({"frames": frames}, path, ["burst", "frame"])
    return U.intact(spark, path, ["frames"])


@query("snk9_preview_rows", f"WITH {V.STAGES_SQL} SELECT stage, '<tr><td>' || stage || '</td><td>' || count(*) || '</td><td>' || CASE WHEN max(ms) < 350 THEN 'ok' ELSE 'slow' END || '</td></tr>' AS row FROM stages GROUP BY stage")
def preview_rows(spark, d):
    g = V.stages(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("top"))
    return g.select("stage", U.html_row(F.col("stage"), F.col("n"), F.when(F.col("top") < 350, "ok").otherwise("slow")).alias("row"))


@query("snk11_narrative", f"WITH {V.STAGES_SQL} SELECT call, stage || ' ' || call AS line FROM stages ORDER BY moment DESC, call DESC LIMIT 4000")
def narrative(spark, d):
    got = U.narrative(V.stages(spark, d), ["moment", "call"])
    return got.select("call", F.concat_ws(" ", "stage", F.col("call").cast("string")).alias("line"))


@query("snk13_emitted_fixture", "SELECT i AS k, '{\"k\":' || i || ',\"prefix\":' || (i * i + 256) || '}' AS doc FROM range(64) r(i)")
def emitted_fixture(spark, d):
    k = F.col("id")
    return spark.range(64).select(k.alias("k"), F.to_json(F.struct(k.alias("k"), (k * k + 256).alias("prefix"))).alias("doc"))


_MLE, _HEUR = (PS._fused_sql(w, c, f) for w, c, f in (("w", "den > 0", "arg_min(y_obs / e, e)"), ("h", "den > 1e-8", "min(y_obs / e)")))


@query("jn19_fuse_pairs", f"SELECT a.cycle, a.y, a.x, a.fused AS likelihood, b.fused AS heuristic FROM ({_MLE}) a JOIN ({_HEUR}) b USING (cycle, y, x)")
def fuse_pairs(spark, d):
    o, keys = PS.observed(spark, d), ["cycle", "y", "x"]
    one = E.fuse_likelihood(o, keys).withColumnRenamed("fused", "likelihood")
    return one.join(E.fuse_heuristic(o, keys).withColumnRenamed("fused", "heuristic"), keys)


@query("jn20_error_fan_out", "SELECT y + dy AS y, x + CASE WHEN y % 2 = 0 THEN dx ELSE -dx END AS x, CAST(sum(share) AS BIGINT) AS weight FROM range(16) a(y), range(16) b(x), (VALUES (0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)) n(dy, dx, share) WHERE y + dy < 16 AND x + CASE WHEN y % 2 = 0 THEN dx ELSE -dx END BETWEEN 0 AND 15 GROUP BY 1, 2")
def error_fan_out(spark, d):
    """How much every site of a frame receives: four neighbours in walk order, mirrored on odd rows."""
    sites = spark.range(256).select(F.floor(F.col("id") / 16).alias("y"), (F.col("id") % 16).alias("x"))
    near = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(s).alias("share")) for a, b, s in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1))])
    out = sites.withColumn("n", F.explode(near)).select((F.col("y") + F.col("n.dy")).alias("y2"), (F.col("x") + F.when(F.col("y") % 2 == 0, F.col("n.dx")).otherwise(-F.col("n.dx"))).alias("x2"), "n.share")
    inside = out.filter(F.col("y2").between(0, 15) & F.col("x2").between(0, 15))
    return inside.groupBy(F.col("y2").alias("y"), F.col("x2").alias("x")).agg(F.sum("share").alias("weight"))


def _q16_sql(source: str) -> str:
    """Cells r, g, b (id named) through the colour path to Q16."""
    return f"{source}, linear_nz AS (SELECT * FROM linear WHERE r > 0 AND g > 0 AND b > 0), oklab AS ({oklab_sql(C.prophoto_to_lms())}) SELECT id, " + ", ".join(f"CAST(floor(lab_{c} * 65536.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS {c}" for c in "lab") + " FROM oklab"


def _to_q16(cells):
    lab = C.to_oklab(cells.filter("r > 0 AND g > 0 AND b > 0"), ["r", "g", "b"], ["lab_l", "lab_a", "lab_b"])
    return lab.select("id", *[C.quantised(F.col(f"lab_{c}")).alias(c) for c in "lab"])


@query("prj44_rung_colour", "WITH " + _q16_sql(f"{V.lattice_sql(64)}, cells AS ({PS._cell_means_sql('lattice', 'cycle', 'v', 4)}), linear AS (SELECT cy * 16 + cx AS id, r / 4096.0::DOUBLE AS r, g / 4096.0::DOUBLE AS g, b / 4096.0::DOUBLE AS b FROM cells)"))
def rung_colour(spark, d):
    """Linear means of a rung, then colour."""
    cells = B.means(B.cell_sums(V.lattice(spark, d), ["cycle"], 4, "v"), ["cycle"])
    return _to_q16(cells.select((F.col("cy") * 16 + F.col("cx")).alias("id"), *[(F.col(c) / 4096.0).alias(c) for c in "rgb"]))


_WINDOWS = "WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)"


def _near(f: str, w: str) -> str:
    return f"coalesce({f}(v, 1) OVER {w}, v)", f"coalesce({f}(v, 2) OVER {w}, {f}(v, 1) OVER {w}, v)"


_N = {k: _near(f, w) for k, f, w in (("w", "lag", "r"), ("e", "lead", "r"), ("n", "lag", "c"), ("s", "lead", "c"))}
FULL = f"""{V.lattice_sql(64)}, s0 AS (SELECT y, x, CAST(v AS DOUBLE) AS v FROM lattice),
s1 AS (SELECT *, {", ".join(f"{one} AS {k}1, {two} AS {k}2" for k, (one, two) in _N.items())} FROM s0 {_WINDOWS}),
s2 AS (SELECT *, 2 * v - w2 - e2 AS h, 2 * v - n2 - s2 AS u, abs(w1 - e1) + abs(2 * v - w2 - e2) AS dh, abs(n1 - s1) + abs(2 * v - n2 - s2) AS dv FROM s1),
s3 AS (SELECT y, x, v, CASE WHEN (y + x) % 2 = 1 THEN v WHEN dh < dv THEN (w1 + e1) / 2 + h / 4 WHEN dv < dh THEN (n1 + s1) / 2 + u / 4 ELSE (w1 + e1 + n1 + s1) / 4 + (h + u) / 8 END AS g FROM s2),
""" + ",\n".join(
    f"""{n}1 AS (SELECT *, CASE WHEN y % 2 = {p} AND x % 2 = {p} THEN v - g END AS d{n} FROM {src}),
{n}2 AS (SELECT *, CASE WHEN y % 2 = {p} THEN coalesce(d{n}, (coalesce(lag(d{n}) OVER r, lead(d{n}) OVER r) + coalesce(lead(d{n}) OVER r, lag(d{n}) OVER r)) / 2) END AS h{n} FROM {n}1 {_WINDOWS}),
{n}3 AS (SELECT *, coalesce(h{n}, (coalesce(lag(h{n}) OVER c, lead(h{n}) OVER c) + coalesce(lead(h{n}) OVER c, lag(h{n}) OVER c)) / 2) + g AS f{n} FROM {n}2 {_WINDOWS})"""
    for n, p, src in (("r", 0, "s3"), ("b", 1, "r3"))
) + ", full_colour AS (SELECT y, x, fr AS r, g, fb AS b FROM b3)"


@query("win4_demosaic", f"WITH {FULL} SELECT * FROM full_colour")
def demosaic(spark, d):
    return D.full_colour(V.lattice(spark, d), ["cycle"], "v").drop("cycle")


@query("agg37_reference_rung", "WITH " + _q16_sql(f"{FULL}, linear AS (SELECT y // 8 * 8 + x // 8 AS id, sum(r) / 64 / 4096.0::DOUBLE AS r, sum(g) / 64 / 4096.0::DOUBLE AS g, sum(b) / 64 / 4096.0::DOUBLE AS b FROM full_colour GROUP BY 1)"))
def reference_rung(spark, d):
    """Box means of the full-resolution demosaic, then colour."""
    full = D.full_colour(V.lattice(spark, d), ["cycle"], "v")
    cells = full.groupBy((F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).alias("id")).agg(*[(F.sum(c) / 64 / 4096.0).alias(c) for c in "rgb"])
    return _to_q16(cells)


def _scenes(spark, d):
    return PF.walk_sites(spark, d).withColumn("pos", F.col("y") * 16 + F.col("x"))


def _bell(spark) -> np.ndarray:
    rows = PF.q16_bell(spark).orderBy("idx").limit(256).collect()
    return np.array([[r["l"], r["a"], r["b"]] for r in rows], float) / 65536


@query("agg34_soft_usage")
def soft_usage(spark, d):
    """Per frame: balance of soft usage at two temperatures."""
    palette = _bell(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["l", "a", "b"]].to_numpy(float) / 65536
        return pd.DataFrame({"frame": pdf["frame"].iloc[:1], "warm": [Q.soft_usage(palette, x, 0.1)[1]], "cold": [Q.soft_usage(palette, x, 0.001)[1]]})

    return _scenes(spark, d).groupBy("frame").applyInPandas(run, "frame long, warm double, cold double")


@query("agg35_map_refinement")
def map_refinement(spark, d):
    """Per frame: mean distance to the palette before and after two neighbourhood-weighted steps."""
    palette = _bell(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["l", "a", "b"]].to_numpy(float) / 65536
        cost = lambda p: float(np.sqrt(((x[:, None] - p[None]) ** 2).sum(2)).min(1).mean())
        return pd.DataFrame({"frame": pdf["frame"].iloc[:1], "before": [cost(palette)], "after": [cost(Q.refine_map(palette, x))]})

    return _scenes(spark, d).groupBy("frame").applyInPandas(run, "frame long, before double, after double")


@query("agg39_baseline_judging")
def baseline_judging(spark, d):
    """Per frame, a clean and a noisy palette's balance before and after settling."""
    out = None
    for name, step in (("clean", 0), ("noisy", 911)):
        palette = PF.q16_bell(spark).withColumn("l", F.col("l") + (F.col("idx") * step) % 1500)
        got = Q.settled_sites(PF.walk_sites(spark, d), palette, 8, budget=2000.0).select("frame", F.lit(name).alias("seed"), "before", "after", "moves")
        out = got if out is None else out.unionByName(got)
    return out


@query("src22_synthetic_files", f"WITH {PF.SEEDS} SELECT 'f' || lpad(CAST(id AS VARCHAR), 6, '0') || '.dng' AS path, CASE WHEN id % 8 = 3 THEN 'MM' ELSE 'II' END AS mark FROM seeds")
def synthetic_files(spark, d):
    return PF.raw_files(spark, d).select("path", F.substring("content", 1, 2).cast("string").alias("mark"))


@query("src18_capture_brackets", f"WITH {PF.RAW_SQL} SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS camera, CAST(count(*) // 4 AS BIGINT) AS brackets FROM files GROUP BY 1")
def capture_brackets(spark, d):
    """Files in capture order, four to a bracket (the stream form is the bracket operator)."""
    from pyspark.sql import Window

    files_ = PF.raw_files(spark, d).select("path", F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("id"))
    camera = F.when(F.col("id") % 2 == 0, "even").otherwise("odd")
    nth = F.floor((F.row_number().over(Window.partitionBy("camera").orderBy("id")) - 1) / 4)
    whole = files_.withColumn("camera", camera).withColumn("nth", nth).groupBy("camera", "nth").agg(F.count(F.lit(1)).alias("n")).filter("n = 4")
    return whole.groupBy("camera").agg(F.count(F.lit(1)).alias("brackets"))
