"""Queries of reports: timings, histograms, envelopes, logs, manifests, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rungwise.functions import lattice as L
from rungwise.operators import ordering as O
from rungwise.operators import statistics as S
from rungwise.registry import query
from rungwise.sources import views as V

ST = V.STAGES_SQL


@query("agg16_stage_report", f"WITH {ST} SELECT stage, CAST(count(*) AS BIGINT) AS calls, quantile_cont(ms, 0.5) AS median_ms, max(ms) AS max_ms, round(CAST(sum(CAST(round(ms * 1e6) AS BIGINT)) AS DOUBLE) / 1e6, 6) AS total_ms FROM stages GROUP BY stage")
def stage_report(spark, d):
    return S.stage_report(V.stages(spark, d))


@query("win11_first_calls", f"WITH {ST}, r AS (SELECT stage, call, ms, row_number() OVER (PARTITION BY stage ORDER BY moment, call) AS nth FROM stages) SELECT * FROM r WHERE nth <= 128")
def first_calls(spark, d):
    return S.first_calls(V.stages(spark, d)).select("stage", "call", "ms", "nth")


@query("srt3_stages_by_total", f"WITH {ST}, t AS (SELECT stage, CAST(sum(CAST(round(ms * 1e6) AS BIGINT)) AS BIGINT) AS total FROM stages GROUP BY stage) SELECT stage, total, CAST(row_number() OVER (ORDER BY total DESC, stage) AS BIGINT) AS place FROM t")
def stages_by_total(spark, d):
    t = V.stages(spark, d).groupBy("stage").agg(F.sum(F.round(F.col("ms") * 1e6).cast("long")).alias("total"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "stage")  # one row a stage
    return t.withColumn("place", F.row_number().over(w).cast("long")).orderBy("place")


@query("srt6_timeline", f"WITH {ST}, s AS (SELECT stage, min(moment) AS first_at, max(moment) AS last_at, max(ms) AS peak FROM stages GROUP BY stage) SELECT stage, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, peak / max(peak) OVER () AS heat FROM s")
def timeline(spark, d):
    t = S.timeline(V.stages(spark, d))
    return t.select("stage", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("first_at", "last_at")], "heat")


@query("agg40_health", f"WITH {ST} SELECT series, call, ms, max(ms) OVER (PARTITION BY series ORDER BY moment, call ROWS UNBOUNDED PRECEDING) AS most FROM (SELECT *, call % 8 AS series FROM stages)")
def health(spark, d):
    rows = V.stages(spark, d).withColumn("series", F.col("call") % 8)
    return O.running_max(rows, ["series"], ["moment", "call"], "ms", "most").select("series", "call", "ms", "most")


LINES = "lines AS (SELECT l_suppkey % 8 AS grp, l_suppkey AS set_id, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 100) AS BIGINT) AS dc, l_returnflag AS flag, l_linestatus AS status, l_orderkey AS o, l_linenumber AS nth FROM lineitem)"


def lines(spark, d):
    q = V.table(spark, d, "lineitem")
    return q.select(
        (F.col("l_suppkey") % 8).alias("grp"), F.col("l_suppkey").alias("set_id"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"),
        F.round(F.col("l_discount") * 100).cast("long").alias("dc"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("nth"),
    )


@query("agg24_set_table", f"WITH {LINES} SELECT set_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(p) AS DOUBLE) / count(*) AS mean_p, count(*) FILTER (flag = 'R') / CAST(count(*) AS DOUBLE) AS returned, CAST(count(*) FILTER (status = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS filled FROM lines GROUP BY set_id")
def set_table(spark, d):
    return lines(spark, d).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("p") / F.count(F.lit(1))).alias("mean_p"), S.share(F.col("flag") == "R").alias("returned"), F.count_if(F.col("status") == "O").alias("open"), F.count_if(F.col("status") == "F").alias("filled")
    )


@query("agg25_equal_width", f"WITH {LINES}, r AS (SELECT grp, p, min(p) OVER w AS lo, (max(p) OVER w - min(p) OVER w) / 10.0::DOUBLE AS width FROM lines WINDOW w AS (PARTITION BY grp)) SELECT grp, least(CAST(floor((p - lo) / nullif(width, 0)) AS BIGINT), 9) AS bucket, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2")
def equal_width(spark, d):
    return S.equal_width(lines(spark, d), ["grp"], "p", 10)


@query("agg26_fixed_range", f"WITH {LINES} SELECT grp, least(CAST(floor((q - 0.0::DOUBLE) / 1.0::DOUBLE) AS BIGINT), 31) AS bucket, CAST(count(*) AS BIGINT) AS n FROM lines WHERE q BETWEEN 0 AND 32 GROUP BY 1, 2")
def fixed_range(spark, d):
    return S.fixed_range(lines(spark, d), ["grp"], "q", 0.0, 32.0, 32)


@query("agg27_correlation", f"""WITH {LINES}, s AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, CAST(sum(q) AS DOUBLE) AS sx, CAST(sum(dc) AS DOUBLE) AS sy, CAST(sum(q * q) AS DOUBLE) AS sxx, CAST(sum(dc * dc) AS DOUBLE) AS syy, CAST(sum(q * dc) AS DOUBLE) AS sxy FROM lines GROUP BY grp)
SELECT grp, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS r FROM s""")
def correlation(spark, d):
    return S.correlation(lines(spark, d), ["grp"], "q", "dc")


@query("set4_intersection", f"WITH {LINES} SELECT grp, CAST(count(*) FILTER (flag = 'R' AND status = 'F') AS BIGINT) AS both, CAST(count(*) FILTER (flag = 'R' OR status = 'F') AS BIGINT) AS either FROM lines GROUP BY grp")
def intersection(spark, d):
    r, f = F.col("flag") == "R", F.col("status") == "F"
    return lines(spark, d).groupBy("grp").agg(F.count_if(r & f).alias("both"), F.count_if(r | f).alias("either"))


@query("agg28_majority", f"WITH {LINES}, c AS (SELECT set_id, flag, count(*) AS n FROM lines GROUP BY 1, 2) SELECT set_id, flag, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY n DESC, flag) = 1")
def majority(spark, d):
    return S.majority(lines(spark, d), ["set_id"], "flag")


@query("srt2_top_codes", f"WITH {LINES}, c AS (SELECT q, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY q) SELECT q, n, n / CAST((SELECT count(*) FROM lines) AS DOUBLE) AS share FROM c ORDER BY n DESC, q LIMIT 10")
def top_codes(spark, d):
    return S.top_codes(lines(spark, d), "q", 10)


@query("agg29_motion", f"WITH {LINES} SELECT set_id, CAST(sum(abs(q - dc * 3)) AS DOUBLE) / count(*) AS mean_abs, min(q - dc * 3) AS least, max(q - dc * 3) AS most FROM lines GROUP BY set_id")
def motion(spark, d):
    x = F.col("q") - F.col("dc") * 3
    return lines(spark, d).groupBy("set_id").agg((F.sum(F.abs(x)) / F.count(F.lit(1))).alias("mean_abs"), F.min(x).alias("least"), F.max(x).alias("most"))


@query("flt10_envelope", f"WITH {LINES} SELECT set_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(p) AS DOUBLE) / count(*) AS mean FROM lines GROUP BY set_id HAVING count(*) >= 100 AND sum(p) / count(*) BETWEEN 1000000 AND 6000000")
def envelope(spark, d):
    g = lines(spark, d).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("p") / F.count(F.lit(1))).alias("mean"))
    return g.filter((F.col("n") >= 100) & F.col("mean").between(1000000, 6000000))


@query("flt11_verdicts", f"WITH {ST} SELECT stage, max(ms) < 350 AS within, avg(CASE WHEN ms < 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.9::DOUBLE AS steady FROM stages GROUP BY stage")
def verdicts(spark, d):
    return V.stages(spark, d).groupBy("stage").agg((F.max("ms") < 350).alias("within"), (F.avg(F.when(F.col("ms") < 100, 1.0).otherwise(0.0)) > 0.9).alias("steady"))


@query("flt12_collapse", f"WITH {V.INDEX_SQL}, c AS (SELECT series, idx, count(*) AS c FROM index_stream GROUP BY 1, 2) SELECT series, CAST(256 * sum(c * c) - sum(c) * sum(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) > 0.9::DOUBLE * 255 * sum(c) AS collapsed FROM c GROUP BY series")
def collapse(spark, d):
    from rungwise.operators import indexstats as I

    b = I.balance(V.index_stream(spark, d), ["series"])
    return b.select("series", (F.col("chi2") > 0.9 * F.lit(255) * F.col("n")).alias("collapsed"))


MOS = f"{V.lattice_sql(64)}, walk AS (SELECT y, x, v, lead(v, 2) OVER w AS v2, lead(v, 4) OVER w AS v4 FROM lattice WINDOW w AS (PARTITION BY y ORDER BY x))"


@query("win3_second_difference", f"WITH {MOS} SELECT y, x, v - 2 * v2 + v4 AS d2 FROM walk")
def second_difference(spark, d):
    return S.second_differences(V.lattice(spark, d), ["y"], "x", "v").select("y", "x", "d2")


@query("win4_stencil", f"WITH {V.lattice_sql(64)} SELECT y, x, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) AS cross FROM lattice WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)")
def stencil(spark, d):
    """Neighbour sums, clamped at the border, by one window along rows and one along columns."""
    r, c = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    v = F.col("v")
    return V.lattice(spark, d).select("y", "x", sum((F.coalesce(f("v").over(w), v) for w in (r, c) for f in (F.lag, F.lead)), F.lit(0).cast("long")).alias("cross"))


BLOCKS = f"{MOS}, blocks AS (SELECT y // 8 AS ry, x // 8 AS rx, CAST(sum(v) AS DOUBLE) / count(*) AS mean, CAST(sum((v - 2 * v2 + v4) * (v - 2 * v2 + v4)) AS DOUBLE) / 6.0::DOUBLE / count(v4) AS var FROM walk GROUP BY 1, 2 HAVING count(v4) > 0), ranked AS (SELECT *, row_number() OVER (ORDER BY mean, ry, rx) - 1 AS r, count(*) OVER () AS n FROM blocks)"


def blocks(spark, d):
    rows = S.second_differences(V.lattice(spark, d), ["y"], "x", "v")
    b = rows.groupBy(F.floor(F.col("y") / 8).alias("ry"), F.floor(F.col("x") / 8).alias("rx")).agg(
        (F.sum("v") / F.count(F.lit(1))).alias("mean"), (F.sum(F.col("d2") * F.col("d2")) / 6.0 / F.count("d2")).alias("var"), F.count("d2").alias("n")
    )
    return b.filter("n > 0").drop("n")


@query("agg21_noise_envelope", f"""WITH {BLOCKS}, q AS (SELECT *, r * 4 // n AS bucket FROM ranked), p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY var) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS c FROM q)
SELECT bucket, var AS p10 FROM p WHERE k = least(CAST(floor(c * 0.1::DOUBLE) AS BIGINT), c - 1)""")
def noise_envelope(spark, d):
    b = blocks(spark, d).withColumn("key", F.struct("mean", "ry", "rx")).withColumn("g", F.lit(0))
    return S.ordered_pick(S.rank_buckets(b, ["g"], "key", 4), ["bucket"], "var", 0.1, "p10")


@query("agg21_noise_line", f"WITH {BLOCKS} SELECT CAST(0 AS INTEGER) AS g, round(regr_slope(var, mean), 6) AS slope, round(regr_intercept(var, mean), 3) AS intercept FROM blocks")
def noise_line(spark, d):
    return S.line_fit(blocks(spark, d).withColumn("g", F.lit(0)), ["g"], "mean", "var").select("g", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("agg22_decile_comparison", f"""WITH {LINES}, a AS (SELECT grp, abs(p - q * 150000) / (1.0::DOUBLE + p) AS rel, (row_number() OVER (PARTITION BY grp ORDER BY p, o, nth, q, dc, set_id) - 1) * 10 // count(*) OVER (PARTITION BY grp) AS bucket FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, bucket ORDER BY rel) - 1 AS k, count(*) OVER (PARTITION BY grp, bucket) AS n FROM a)
SELECT grp, bucket, max(CASE WHEN k = least(CAST(floor(n * 0.5::DOUBLE) AS BIGINT), n - 1) THEN rel END) AS median, max(CASE WHEN k = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) THEN rel END) AS p95 FROM r GROUP BY 1, 2""")
def decile_comparison(spark, d):
    a = lines(spark, d).withColumn("rel", F.abs(F.col("p") - F.col("q") * 150000) / (F.lit(1.0) + F.col("p"))).withColumn("key", F.struct("p", "o", "nth", "q", "dc", "set_id"))
    b = S.rank_buckets(a, ["grp"], "key", 10)
    return S.ordered_pick(b, ["grp", "bucket"], "rel", 0.5, "median").join(S.ordered_pick(b, ["grp", "bucket"], "rel", 0.95, "p95"), ["grp", "bucket"])


@query("win10_trail", f"WITH {ST} SELECT stage, call, CASE WHEN max(ms) OVER w > min(ms) OVER w THEN (ms - min(ms) OVER w) / (max(ms) OVER w - min(ms) OVER w) ELSE 0 END AS scaled FROM stages WINDOW w AS (PARTITION BY stage ORDER BY moment, call ROWS 31 PRECEDING)")
def trail(spark, d):
    return S.scaled_trail(V.stages(spark, d), ["stage"], ["moment", "call"], "ms").select("stage", "call", "scaled")


@query("win9_time_to_finish", f"WITH {ST} SELECT stage, epoch_us(max(moment)) - epoch_us(min(moment)) AS elapsed_us, CAST(count(*) - 1 AS BIGINT) AS steps, arg_min(ms, ROW(moment, call)) AS first_ms, arg_max(ms, ROW(moment, call)) AS last_ms FROM stages GROUP BY stage")
def time_to_finish(spark, d):
    at = lambda f: F.unix_micros(f("moment").cast("timestamp"))
    return V.stages(spark, d).groupBy("stage").agg(
        (at(F.max) - at(F.min)).alias("elapsed_us"), (F.count(F.lit(1)) - 1).alias("steps"), F.min_by("ms", F.struct("moment", "call")).alias("first_ms"), F.max_by("ms", F.struct("moment", "call")).alias("last_ms")
    )


@query("win12_newer_only", f"WITH {V.INDEX_SQL}, r AS (SELECT series, pos, epoch_us(moment) AS us, max(epoch_us(moment)) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM index_stream) SELECT series, pos FROM r WHERE shown IS NULL OR us > shown")
def newer_only(spark, d):
    """Rows in arrival order whose time is past everything shown before."""
    w = Window.partitionBy("series").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    r = V.index_stream(spark, d).withColumn("shown", F.max("moment").over(w))
    return r.filter(F.col("shown").isNull() | (F.col("moment") > F.col("shown"))).select("series", "pos")


@query("win6_hardest", f"WITH {LINES}, s AS (SELECT set_id, CAST(sum(p % 1000) AS BIGINT) AS score FROM lines GROUP BY set_id) SELECT set_id, score, CAST(row_number() OVER (ORDER BY score DESC, set_id) AS BIGINT) AS place FROM s QUALIFY place <= 10")
def hardest(spark, d):
    s = lines(spark, d).groupBy("set_id").agg(F.sum(F.col("p") % 1000).alias("score"))
    top = s.orderBy(F.desc("score"), "set_id").limit(10)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "set_id")).cast("long"))


def _scaled_sql(c: str) -> str:
    return f"({c}) / (avg({c}) OVER (PARTITION BY grp) + 1e-12::DOUBLE)"


def _kept_sql(c: str) -> str:
    return f"greatest(0.25::DOUBLE, least({c}, 4.0::DOUBLE))"


_BLENDED = [_kept_sql(f"0.5::DOUBLE + 0.5::DOUBLE * {_scaled_sql(c)}") for c in "ab"]


@query("agg36_combined_weights", f"WITH {LINES}, t AS (SELECT grp, set_id, CAST(sum(q) AS DOUBLE) AS a, CAST(sum(dc) AS DOUBLE) AS b FROM lines GROUP BY 1, 2), p AS (SELECT grp, set_id, {_BLENDED[0]} * {_BLENDED[1]} AS p FROM t) SELECT grp, set_id, round({_kept_sql(_scaled_sql('p'))}, 9) AS weight FROM p")
def combined_weights(spark, d):
    t = lines(spark, d).groupBy("grp", "set_id").agg(F.sum("q").cast("double").alias("a"), F.sum("dc").cast("double").alias("b"))
    return S.combined_weights(t, ["grp"], "a", "b", 0.5).select("grp", "set_id", F.round("weight", 9).alias("weight"))


@query("agg20_likelihood_map", f"WITH {V.lattice_sql(64)} SELECT y // 2 AS cy, x // 2 AS cx, round(sum(CASE WHEN v >= 4000 THEN 0.0::DOUBLE ELSE 4096.0::DOUBLE / (v + 64) END) * (1.0::DOUBLE - count(*) FILTER (v >= 4000) / 4.0::DOUBLE), 9) AS certainty FROM lattice GROUP BY 1, 2")
def likelihood_map(spark, d):
    v = F.col("v")
    return V.lattice(spark, d).groupBy(F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(
        F.round(F.sum(F.when(v >= 4000, 0.0).otherwise(F.lit(4096.0) / (v + 64))) * (1.0 - F.count_if(v >= 4000) / 4.0), 9).alias("certainty")
    )


@query("agg17_clip_fraction", f"WITH {LINES}, h AS (SELECT flag, least(p * 256 // 10500000, 255) AS bin, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1, 2) SELECT flag, CAST(sum(n) FILTER (bin >= 250) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS clipped, max(n) AS peak FROM h GROUP BY flag")
def clip_fraction(spark, d):
    h = lines(spark, d).groupBy("flag", F.least(F.floor(F.col("p") * 256 / 10500000), F.lit(255).cast("long")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("flag").agg((F.sum(F.when(F.col("bin") >= 250, F.col("n"))) / F.sum("n")).alias("clipped"), F.max("n").alias("peak"))


@query("agg30_judged", f"WITH {LINES}, m AS (SELECT set_id, grp, CAST(sum(p) AS DOUBLE) / count(*) AS mean FROM lines GROUP BY 1, 2), b AS (SELECT grp, CAST(sum(p) AS DOUBLE) / count(*) AS base FROM lines GROUP BY 1) SELECT grp, CAST(count(*) AS BIGINT) AS sets, CAST(count(*) FILTER (mean < base) AS BIGINT) AS better FROM m JOIN b USING (grp) GROUP BY grp")
def judged(spark, d):
    """How many sets beat their group's baseline."""
    mean = (F.sum("p") / F.count(F.lit(1))).alias("mean")
    m = lines(spark, d).groupBy("set_id", "grp").agg(mean)
    b = lines(spark, d).groupBy("grp").agg(mean.alias("base"))
    return m.join(b, "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("sets"), F.count_if(F.col("mean") < F.col("base")).alias("better"))


# ---------------------------------------------------------------- bitfields, text, manifests

CODES = "codes AS (SELECT l_orderkey AS o, l_linenumber AS nth, l_suppkey AS s, (l_orderkey * 2654435761 + l_partkey * 97 + l_suppkey) % 4294967296 AS code FROM lineitem)"


def codes(spark, d):
    q = V.table(spark, d, "lineitem")
    return q.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("nth"), F.col("l_suppkey").alias("s"), ((F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 97 + F.col("l_suppkey")) % 4294967296).alias("code"))


def bits(code, at: int, mask: int):
    return F.shiftright(code, at).bitwiseAND(F.lit(mask).cast("long"))


@query("prj36_bitfields", f"WITH {CODES} SELECT o, nth, s, code >> 30 & 3 AS class, (code >> 24 & 63) / 2.0::DOUBLE AS chi2, (code & 255) / 2.0::DOUBLE AS sigma, ((code >> 8 & 255) - CASE WHEN (code >> 8 & 255) >= 128 THEN 256 ELSE 0 END) / 64.0::DOUBLE AS skew FROM codes")
def bitfields(spark, d):
    c = F.col("code")
    raw = bits(c, 8, 255)
    return codes(spark, d).select("o", "nth", "s", bits(c, 30, 3).alias("class"), (bits(c, 24, 63) / 2.0).alias("chi2"), (bits(c, 0, 255) / 2.0).alias("sigma"), ((raw - F.when(raw >= 128, 256).otherwise(0)) / 64.0).alias("skew"))


@query("prj37_base4_decode", f"WITH {CODES} SELECT o, nth, s, CAST(f AS BIGINT) AS frame, 10.0::DOUBLE + (code >> (2 * f) & 3) / 3.0::DOUBLE * (90.0::DOUBLE - 10.0::DOUBLE) AS v FROM codes, range(4) r(f)")
def base4_decode(spark, d):
    """Two bits a frame between a bin's least and greatest value."""
    f = codes(spark, d).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(3))))
    digit = F.expr("shiftright(code, 2 * frame) & 3L")
    return f.select("o", "nth", "s", F.col("frame").cast("long").alias("frame"), (F.lit(10.0) + digit / F.lit(3.0) * (F.lit(90.0) - F.lit(10.0))).alias("v"))


@query("prj27_error_shares", f"WITH {CODES}, e AS (SELECT o, nth, s, code % 20001 - 10000 AS e FROM codes), p AS (SELECT *, (7 * e) >> 4 AS s7, (3 * e) >> 4 AS s3, (5 * e) >> 4 AS s5, e >> 4 AS s1 FROM e) SELECT o, nth, s, s7 + (e - (s7 + s3 + s5 + s1)) AS east, s3 AS southwest, s5 AS south, s1 AS southeast FROM p")
def error_shares(spark, d):
    e = codes(spark, d).withColumn("e", F.col("code") % 20001 - 10000)
    parts = L.error_shares(F.col("e"))
    return e.select("o", "nth", "s", *[p.alias(n) for p, n in zip(parts, ("east", "southwest", "south", "southeast"))])


@query("agg32_conservation", f"WITH {CODES} SELECT s, CAST(sum(code % 20001 - 10000) AS BIGINT) AS given, CAST(sum(code % 20001 - 10000) AS BIGINT) AS shared FROM codes GROUP BY s")
def conservation(spark, d):
    """Shares of an error add up to it."""
    e = codes(spark, d).withColumn("e", F.col("code") % 20001 - 10000)
    parts = L.error_shares(F.col("e"))
    return e.groupBy("s").agg(F.sum("e").alias("given"), F.sum(parts[0] + parts[1] + parts[2] + parts[3]).alias("shared"))


@query("snk3_encoded_length", "SELECT o_orderkey AS id, 801 + f * (18 + 1 + d + (d + 254) // 255 + 1) AS bytes FROM (SELECT o_orderkey, o_custkey % 64 AS f, (9 * (1 + n + greatest(1, (n + 253) // 254) - 1 + 1) + 7) // 8 AS d FROM (SELECT *, (o_orderkey % 500) * (o_orderkey % 500) AS n FROM orders))")
def encoded_length(spark, d):
    side, frames = F.col("o_orderkey") % 500, F.col("o_custkey") % 64
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), L.encoded_length(side, frames).alias("bytes"))


@query("snk7_manifest", "SELECT doc_id AS id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS digest FROM documents")
def manifest(spark, d):
    t = F.coalesce("text", F.lit("")).cast("binary")
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length(t).cast("long").alias("bytes"), F.sha2(t, 256).alias("digest"))


@query("snk8_provenance", "SELECT event_type AS stage, 3 AS schema_version, 'rungwise' AS producer, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY event_type")
def provenance(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.lit(3).alias("schema_version"), F.lit("rungwise").alias("producer"), F.count(F.lit(1)).alias("rows"))


@query("fn1_regex_extract", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_replace(url, '^https?://', '') AS bare FROM pages")
def regex_extract(spark, d):
    u = F.col("url")
    return V.table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, "/([a-z]{2})/", 1).alias("lang"), F.regexp_replace(u, "^https?://", "").alias("bare"))


@query("fn3_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return V.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("fn5_time_format", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def time_format(spark, d):
    return V.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("compact"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("fn6_array_slice", "SELECT vec_id, CAST(list_sum(list_transform(embedding[1:8], lambda x: CAST(floor(CAST(x AS DOUBLE) * 65536) AS BIGINT))) AS BIGINT) AS head, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def array_slice(spark, d):
    head = F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 65536))
    return V.table(spark, d, "embeddings").select("vec_id", F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a + x).alias("head"), F.size("embedding").alias("n"))


@query("fn7_map_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code FROM events")
def map_lookup(spark, d):
    codes_ = F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))
    return V.table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(codes_, F.col("event_type")), F.lit(0)).alias("code"))


@query("fn8_base64", "SELECT item_id, to_base64(encode(text)) AS embedded FROM benchmark")
def base64_embed(spark, d):
    b = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")
    return V.table(spark, d, "benchmark").select("item_id", b.alias("embedded"))


@query("fn9_endian", f"WITH {CODES} SELECT o, nth, s, (code & 255) * 16777216 + (code >> 8 & 255) * 65536 + (code >> 16 & 255) * 256 + (code >> 24 & 255) AS swapped FROM codes")
def endian(spark, d):
    c = F.col("code")
    return codes(spark, d).select("o", "nth", "s", (bits(c, 0, 255) * 16777216 + bits(c, 8, 255) * 65536 + bits(c, 16, 255) * 256 + bits(c, 24, 255)).alias("swapped"))


@query("fn4_hex_digest", "SELECT item_id, md5(text) AS digest FROM benchmark")
def hex_digest(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("set3_complement", "SELECT DISTINCT o_orderkey % 6 AS limit_at, list_filter(CAST([16, 32, 64, 128, 256, 512] AS BIGINT[]), lambda r: r > 16 * (1 << CAST(o_orderkey % 6 AS INTEGER))) AS above FROM orders")
def complement(spark, d):
    rungs = F.array(*[F.lit(r).cast("long") for r in (16, 32, 64, 128, 256, 512)])
    rows = V.table(spark, d, "orders").select((F.col("o_orderkey") % 6).alias("limit_at")).distinct()
    below = F.filter(rungs, lambda r: r <= 16 * F.pow(F.lit(2.0), F.col("limit_at")))
    return rows.select("limit_at", F.array_except(rungs, below).alias("above"))


@query("srt5_greedy_order", f"WITH {V.PROBES_SQL}, r AS (SELECT t.pos, p.idx, (p.l - t.l) * (p.l - t.l) + (p.a - t.a) * (p.a - t.a) + (p.b - t.b) * (p.b - t.b) AS d2 FROM targets t, palette p), k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d2, idx) - 1 AS rank FROM r), c AS (SELECT pos, rank, idx, d2 - min(d2) OVER (PARTITION BY pos) AS cost FROM k WHERE rank < 8) SELECT pos, rank, idx, cost, CAST(row_number() OVER (ORDER BY cost, pos, rank) - 1 AS BIGINT) AS place FROM c WHERE rank > 0 AND cost <= 40000000")
def greedy_order(spark, d):
    """Candidate moves within budget (every option but the nearest) in one total order of cost."""
    from rungwise.operators import palette as P

    palette, targets = V.probes(spark, d)
    k = P.alternatives(targets, palette, 8)
    cost = F.col("d2") - F.min("d2").over(Window.partitionBy("pos"))
    c = k.withColumn("cost", cost).filter("rank > 0 AND cost <= 40000000").select("pos", "rank", "idx", "cost")
    return O.ranked(c, [], ["cost", "pos", "rank"]).withColumnRenamed("_r", "place").drop("_n")


@query("flt5_in_frame", f"WITH {V.lattice_sql(64)} SELECT y, x, CAST((x < 63)::INT + (y < 63 AND x > 0)::INT + (y < 63)::INT + (y < 63 AND x < 63)::INT AS BIGINT) AS inside FROM lattice")
def in_frame(spark, d):
    """How many of the four neighbours that take an error lie in the frame."""
    rows = V.lattice(spark, d)
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = rows.withColumn("n", F.explode(steps)).withColumn("ny", F.col("y") + F.col("n.dy")).withColumn("nx", F.col("x") + F.col("n.dx"))
    return near.groupBy("y", "x").agg(F.count_if(F.col("ny").between(0, 63) & F.col("nx").between(0, 63)).alias("inside"))


@query("flt9_move_candidates", f"WITH {V.PROBES_SQL}, r AS (SELECT t.pos, p.idx, (p.l - t.l) * (p.l - t.l) + (p.a - t.a) * (p.a - t.a) + (p.b - t.b) * (p.b - t.b) AS d2 FROM targets t, palette p), k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d2, idx) - 1 AS rank FROM r) SELECT pos, idx, d2 FROM k WHERE rank BETWEEN 1 AND 7 AND d2 < 100000000")
def move_candidates(spark, d):
    from rungwise.operators import palette as P

    palette, targets = V.probes(spark, d)
    return P.alternatives(targets, palette, 8).filter("rank > 0 AND d2 < 100000000").select("pos", "idx", "d2")
