"""Queries over index streams, cycles of frames, scenes and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rungwise.functions import lattice as L
from rungwise.operators import exposure as E
from rungwise.operators import indexstats as I
from rungwise.operators import scene as S
from rungwise.operators import temporal as T
from rungwise.registry import query
from rungwise.sources import views as V

X = V.INDEX_SQL
USAGE = f"{X}, usage AS (SELECT s.series, i.idx, CAST(count(x.pos) AS BIGINT) AS n FROM (SELECT DISTINCT series FROM index_stream) s CROSS JOIN (SELECT unnest(range(256)) AS idx) i LEFT JOIN index_stream x ON x.series = s.series AND x.idx = i.idx GROUP BY 1, 2)"


@query("agg8_usage", f"WITH {USAGE} SELECT * FROM usage")
def usage(spark, d):
    return I.usage(V.index_stream(spark, d), ["series"])


BALANCE = f"{X}, c AS (SELECT series, idx, count(*) AS c FROM index_stream GROUP BY 1, 2), b AS (SELECT series, CAST(sum(c) AS BIGINT) AS n, CAST(256 * sum(c * c) - sum(c) * sum(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS chi2, list(c ORDER BY c) AS cs FROM c GROUP BY 1)"


@query("agg9_balance", f"WITH {BALANCE} SELECT series, n, chi2 FROM b")
def balance(spark, d):
    return I.balance(V.index_stream(spark, d), ["series"]).select("series", "n", "chi2")


@query("agg10_entropy", f"WITH {BALANCE} SELECT series, round(-list_sum(list_transform(cs, lambda c: c / CAST(n AS DOUBLE) * log2(c / CAST(n AS DOUBLE)))), 9) AS entropy FROM b")
def entropy(spark, d):
    return I.balance(V.index_stream(spark, d), ["series"]).select("series", F.round("entropy", 9).alias("entropy"))


@query("prj34_bits_lost", f"WITH {BALANCE} SELECT series, round(chi2 / (2 * ln(2::DOUBLE)), 6) AS bits_lost, round(256.0::DOUBLE / n * 256 * (n * (1 / 256.0::DOUBLE) * (255 / 256.0::DOUBLE)), 9) AS expected FROM b")
def bits_lost(spark, d):
    return I.balance(V.index_stream(spark, d), ["series"]).select("series", F.round("bits_lost", 6).alias("bits_lost"), F.round(I.expected_balance(F.col("n")), 9).alias("expected"))


@query(
    "prj33_swap_delta",
    f"WITH {USAGE}, a AS (SELECT series, max(CASE WHEN idx = 3 THEN n END) AS p, max(CASE WHEN idx = 200 THEN n END) AS q, CAST(sum(n) AS BIGINT) AS n FROM usage GROUP BY series) SELECT series, 512.0::DOUBLE * (q - p + 1) / n AS delta FROM a",
)
def swap_delta(spark, d):
    u = I.usage(V.index_stream(spark, d), ["series"])
    a = u.groupBy("series").agg(F.max(F.when(F.col("idx") == 3, F.col("n"))).alias("p"), F.max(F.when(F.col("idx") == 200, F.col("n"))).alias("q"), F.sum("n").alias("n"))
    return a.select("series", L.swap_delta(F.col("p"), F.col("q"), F.col("n")).alias("delta"))


@query("seq5_defection", f"WITH {USAGE} SELECT series, idx, n + CASE WHEN idx = 3 THEN -1 WHEN idx = 200 THEN 1 ELSE 0 END AS n FROM usage")
def defection(spark, d):
    return I.moved(I.usage(V.index_stream(spark, d), ["series"]), ["series"], 3, 200)


LAGGED = f"{X}, lagged AS (SELECT *, lag(idx) OVER (PARTITION BY series ORDER BY moment, pos) AS before FROM index_stream)"


@query("jn9_consecutive", f"WITH {LAGGED} SELECT series, pos, before, idx FROM lagged WHERE before IS NOT NULL AND before <> idx")
def consecutive(spark, d):
    return I.changes(V.index_stream(spark, d), ["series"], ["moment", "pos"]).select("series", "pos", "before", "idx")


@query("agg18_churn", f"WITH {LAGGED} SELECT series, CAST(count(before) AS BIGINT) AS steps, CAST(count(*) FILTER (before <> idx) AS BIGINT) AS churn FROM lagged GROUP BY series")
def churn(spark, d):
    return I.churn(V.index_stream(spark, d), ["series"], ["moment", "pos"])


@query("win2_lag_across_cycles", f"WITH {X} SELECT series, pos, idx, lag(idx, 4) OVER (PARTITION BY series ORDER BY moment, pos) AS four_before FROM index_stream")
def lag_across_cycles(spark, d):
    w = Window.partitionBy("series").orderBy("moment", "pos")
    return V.index_stream(spark, d).select("series", "pos", "idx", F.lag("idx", 4).over(w).alias("four_before"))


FRAMES = f"{X}, one AS (SELECT pos, idx FROM index_stream), other AS (SELECT pos, CASE WHEN pos % 5 = 0 THEN (idx + 1) % 256 ELSE idx END AS idx FROM one)"


def frames(spark, d):
    one = V.index_stream(spark, d).select("pos", "idx")
    return one, one.select("pos", F.when(F.col("pos") % 5 == 0, (F.col("idx") + 1) % 256).otherwise(F.col("idx")).alias("idx"))


@query("flt4_changed", f"WITH {FRAMES} SELECT o.pos, o.idx FROM other o JOIN one USING (pos) WHERE o.idx <> one.idx")
def changed(spark, d):
    return I.delta(*frames(spark, d))


@query("jn10_apply_delta", f"WITH {FRAMES} SELECT pos, idx FROM other")
def apply_delta(spark, d):
    """A frame and its delta give the next frame back."""
    one, other = frames(spark, d)
    return I.applied(one, I.delta(one, other))


# ---------------------------------------------------------------- cycle statistics

SIDE, RUNG, SEED = 32, 8, 4


def ev_frames(spark, d):
    """cycle, frame, ev, y, x, v: every site of four frames, in integer units (0 where the table has none)."""
    seen = V.mosaic(spark, d)
    sites = spark.range(4 * SIDE * SIDE).select(F.floor(F.col("id") / (SIDE * SIDE)).alias("frame"), (F.floor(F.col("id") / SIDE) % SIDE).alias("y"), (F.col("id") % SIDE).alias("x"))
    places = seen.select("cycle").distinct().crossJoin(F.broadcast(sites))  # the sites of one cycle
    filled = places.join(seen, ["cycle", "frame", "y", "x"], "left").select("cycle", "frame", "y", "x", F.coalesce("dn", F.lit(V.BLACK).cast("long")).alias("v"))
    ev = F.element_at(F.array(*[F.lit(x) for x in (1.0, 4.0, 16.0, 64.0)]), (F.col("frame") + 1).cast("int"))
    return filled.withColumn("ev", ev)


EVF = f"""{V.mosaic_sql()}, evf AS (SELECT p.cycle, p.frame, p.y, p.x, coalesce(m.dn, {V.BLACK}) AS v, CASE p.frame WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE WHEN 2 THEN 16.0::DOUBLE ELSE 64.0::DOUBLE END AS ev
  FROM (SELECT cycle, i // {SIDE * SIDE} AS frame, i // {SIDE} % {SIDE} AS y, i % {SIDE} AS x FROM (SELECT DISTINCT cycle FROM mosaic), range({4 * SIDE * SIDE}) r(i)) p LEFT JOIN mosaic m USING (cycle, frame, y, x)),
cells AS (SELECT cycle, frame, ev, y // 4 AS cy, x // 4 AS cx, CAST(sum(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS DOUBLE) / 4.0::DOUBLE AS r, CAST(sum(v) FILTER (y % 2 <> x % 2) AS DOUBLE) / 8.0::DOUBLE AS g, CAST(sum(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS DOUBLE) / 4.0::DOUBLE AS b FROM evf GROUP BY ALL),
t AS (SELECT cycle, cy, cx, list(ev ORDER BY frame) AS e, list(r ORDER BY frame) AS r, list(g ORDER BY frame) AS g, list(b ORDER BY frame) AS b, list(r - g ORDER BY frame) AS q1, list(b - g ORDER BY frame) AS q2 FROM cells GROUP BY ALL),
mu AS (SELECT *, """ + ", ".join(f"(((0.0::DOUBLE + e[1] * {k}[1]) + e[2] * {k}[2]) + e[3] * {k}[3] + e[4] * {k}[4]) / 85.0::DOUBLE AS mu_{k}" for k in ("r", "g", "b", "q1", "q2")) + """ FROM t),
ss AS (SELECT *, """ + ", ".join("(" + " + ".join(f"e[{i}] * ({k}[{i}] - mu_{k}) * ({k}[{i}] - mu_{k})" for i in range(1, 5)) + f") AS ss_{k}" for k in ("r", "g", "b", "q1", "q2")) + """ FROM mu),
ratios AS (SELECT cycle, unnest([""" + ", ".join(f"CASE WHEN mu_{c} > 0 THEN ss_{c} / 3.0::DOUBLE / (mu_{c} / {n}.0::DOUBLE) ELSE 0 END" for c, n in (("r", 4), ("g", 8), ("b", 4))) + """]) AS ratio FROM ss),
gain AS (SELECT cycle, list_sort(list(ratio))[len(list(ratio)) // 2 + 1] AS gain FROM ratios GROUP BY cycle),
v AS (SELECT ss.*, gain, gain * mu_r / 4.0::DOUBLE + gain * mu_g / 8.0::DOUBLE AS v1, gain * mu_b / 4.0::DOUBLE + gain * mu_g / 8.0::DOUBLE AS v2 FROM ss JOIN gain USING (cycle)),
bins AS (SELECT cycle, cy, cx, mu_r, mu_g, mu_b, (CASE WHEN v1 > 0 THEN ss_q1 / (3.0::DOUBLE * v1) ELSE 0 END + CASE WHEN v2 > 0 THEN ss_q2 / (3.0::DOUBLE * v2) ELSE 0 END) / 2 AS d FROM v)"""


@query("agg12_cycle_bins", f"WITH {EVF} SELECT * FROM bins")
def cycle_bins(spark, d):
    return T.cycle_statistics(ev_frames(spark, d), SIDE, RUNG, SEED)[0]


@query("agg12_noise_gain", f"WITH {EVF} SELECT * FROM gain")
def noise_gain(spark, d):
    return T.cycle_statistics(ev_frames(spark, d), SIDE, RUNG, SEED)[1]


@query("agg12_sigma_time", f"WITH {EVF}, s AS (SELECT cycle, cy // 2 AS sy, cx // 2 AS sx, list(d ORDER BY cy, cx) AS ds FROM bins GROUP BY ALL) SELECT cycle, sy, sx, (((0.0::DOUBLE + ds[1]) + ds[2]) + ds[3] + ds[4]) / 4.0::DOUBLE AS sigma_time FROM s")
def sigma_time(spark, d):
    return T.cycle_statistics(ev_frames(spark, d), SIDE, RUNG, SEED)[2]


@query("agg38_region_median", f"WITH {EVF} SELECT cycle, list_sort(list(d))[len(list(d)) // 2 + 1] AS median FROM bins WHERE cy < 4 AND cx < 4 GROUP BY cycle")
def region_median(spark, d):
    bins = T.cycle_statistics(ev_frames(spark, d), SIDE, RUNG, SEED)[0]
    return T.region_median(bins, (F.col("cy") < 4) & (F.col("cx") < 4), "d")


@query("srt1_upper_median", f"WITH {V.STAGES_SQL} SELECT stage, list_sort(list(ms))[len(list(ms)) // 2 + 1] AS median FROM stages GROUP BY stage")
def upper_median(spark, d):
    return T.upper_median(V.stages(spark, d), ["stage"], "ms", "median")


@query("agg19_deciles", f"WITH {V.STAGES_SQL}, s AS (SELECT stage, list_sort(list(ms)) AS v FROM stages GROUP BY stage) SELECT stage, CAST(i AS BIGINT) AS decile, v[least(len(v) - 1, i * len(v) // 10) + 1] AS value FROM s, range(11) r(i)")
def deciles(spark, d):
    return T.deciles(V.stages(spark, d), ["stage"], "ms")


# ---------------------------------------------------------------- scenes and plans

TOP = 105_000.0


def values(spark, d):
    """cycle, channel, v in about [0, 1]."""
    q = V.table(spark, d, "lineitem")
    channel = F.when(F.col("l_returnflag") == "A", "R").when(F.col("l_returnflag") == "N", "G").otherwise("B")
    return q.select((F.col("l_suppkey") % 16).alias("cycle"), channel.alias("channel"), (F.col("l_extendedprice") / F.lit(TOP)).alias("v"))


VALUES = f"vals AS (SELECT l_suppkey % 16 AS cycle, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'N' THEN 'G' ELSE 'B' END AS channel, l_extendedprice / {TOP}::DOUBLE AS v FROM lineitem)"
HIST = f"{VALUES}, hist AS (SELECT cycle, channel, least(CAST(floor(greatest(0.0::DOUBLE, least(v, 1.0::DOUBLE)) * 1024.0::DOUBLE) AS BIGINT), 1023) AS bin, CAST(count(*) AS BIGINT) AS n FROM vals GROUP BY ALL)"
RUN = f"{HIST}, run AS (SELECT *, sum(n) OVER (PARTITION BY cycle, channel ORDER BY bin) AS c, sum(n) OVER (PARTITION BY cycle, channel) AS t FROM hist)"


def hist(spark, d):
    return S.histogram(values(spark, d), ["cycle", "channel"], "v")


@query("agg14_histogram", f"WITH {HIST} SELECT * FROM hist")
def histogram(spark, d):
    return hist(spark, d)


@query("prj46_bin_index", f"WITH {VALUES} SELECT cycle, channel, v, least(CAST(floor(greatest(0.0::DOUBLE, least(v, 1.0::DOUBLE)) * 256.0::DOUBLE) AS BIGINT), 255) AS bin, (least(CAST(floor(greatest(0.0::DOUBLE, least(v, 1.0::DOUBLE)) * 256.0::DOUBLE) AS BIGINT), 255) + 0.5::DOUBLE) / 256.0::DOUBLE AS centre FROM vals")
def bin_index(spark, d):
    return values(spark, d).withColumn("bin", L.bin_index(F.col("v"), 256)).withColumn("centre", L.bin_centre(F.col("bin"), 256))


@query("win1_running_count", f"WITH {RUN} SELECT cycle, channel, bin, CAST(c AS BIGINT) AS running FROM run")
def running_count(spark, d):
    w = Window.partitionBy("cycle", "channel").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist(spark, d).select("cycle", "channel", "bin", F.sum("n").over(w).alias("running"))


@query("agg14_percentile", f"WITH {RUN} SELECT cycle, channel, (min(bin) + 0.5::DOUBLE) / 1024.0::DOUBLE AS level FROM run WHERE c >= t * 0.995::DOUBLE GROUP BY ALL")
def percentile(spark, d):
    return S.percentile(hist(spark, d), ["cycle", "channel"], 0.995, "level")


def _room(level: str, target: float) -> str:
    return f"greatest(-5.0::DOUBLE, least(log2({target}::DOUBLE / greatest({level}, 1e-4::DOUBLE)), 5.0::DOUBLE))"


CLIPS = f"""{RUN}, hi AS (SELECT cycle, channel, (min(bin) + 0.5::DOUBLE) / 1024.0::DOUBLE AS v FROM run WHERE c >= t * 0.995::DOUBLE GROUP BY ALL),
lo AS (SELECT cycle, (min(bin) + 0.5::DOUBLE) / 1024.0::DOUBLE AS v FROM run WHERE channel = 'G' AND c >= t * 0.02::DOUBLE GROUP BY ALL),
wide AS (SELECT hi.cycle, max(hi.v) FILTER (channel = 'R') AS r, max(hi.v) FILTER (channel = 'G') AS g, max(hi.v) FILTER (channel = 'B') AS b, max(coalesce(lo.v, 0)) AS low FROM hi LEFT JOIN lo USING (cycle) GROUP BY 1),
rooms AS (SELECT cycle, {", ".join(f"CASE WHEN coalesce({c}, 0) >= 0.02::DOUBLE THEN {_room(c, 0.95)} ELSE 0 END AS room_{c}, coalesce({c}, 0) >= 0.02::DOUBLE AS present_{c}" for c in "rgb")}, {_room("greatest(low, 1e-4::DOUBLE)", 0.25)} AS want FROM wide),
clips AS (SELECT * EXCLUDE (want), greatest(1.0::DOUBLE, least(want - room_g, 4.0::DOUBLE)) AS shadow_depth FROM rooms)"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("agg15_scene_clips", f"WITH {CLIPS} SELECT cycle, present_r, present_g, present_b, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("room_r", "room_g", "room_b", "shadow_depth")) + " FROM clips")
def scene_clips(spark, d):
    return rounded(S.clips(hist(spark, d), ["cycle"]), "room_r", "room_g", "room_b", "shadow_depth")


@query("prj30_room_stops", f"WITH {VALUES} SELECT cycle, channel, v, round({_room('v', 0.95)}, 9) AS room FROM vals")
def room_stops(spark, d):
    return values(spark, d).withColumn("room", F.round(L.room_stops(F.col("v"), 0.95), 9))


@query("prj32_exposure_plan", f"WITH {CLIPS} SELECT cycle, round(room_g, 9) AS ev_green, round(CASE WHEN present_r THEN room_r ELSE room_g + log2(2.1::DOUBLE) END, 9) AS ev_red, round(CASE WHEN present_b THEN room_b ELSE room_g + log2(1.6::DOUBLE) END, 9) AS ev_blue, round(room_g + shadow_depth, 9) AS ev_shadow FROM clips")
def exposure_plan(spark, d):
    return rounded(S.planned(S.clips(hist(spark, d), ["cycle"]), ["cycle"], (2.1, 1.0, 1.6)), "ev_green", "ev_red", "ev_blue", "ev_shadow")


PLANS = f"{V.EXPOSURES_SQL}, plans AS (SELECT cycle, frame, CASE WHEN t > 0.1 THEN iso / 100 END AS plan FROM exposures)"


def plans(spark, d):
    return V.exposures(spark, d).select("cycle", "frame", F.when(F.col("t") > 0.1, F.col("iso") / 100).alias("plan"))


@query("prj31_bounded_plan", f"WITH {PLANS} SELECT cycle, frame, greatest(2.0::DOUBLE, least(coalesce(plan, 3.0::DOUBLE), 8.0::DOUBLE)) AS plan FROM plans")
def bounded_plan(spark, d):
    return plans(spark, d).select("cycle", "frame", S.bounded_plan(F.col("plan"), 3.0, 2.0, 8.0).alias("plan"))


@query("jn14_last_known_plan", f"WITH {PLANS} SELECT cycle, frame, coalesce(last_value(plan IGNORE NULLS) OVER (PARTITION BY cycle ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS plan FROM plans")
def last_known_plan(spark, d):
    got = S.last_known(plans(spark, d), ["cycle"], "frame", "plan")
    return got.select("cycle", "frame", F.coalesce("known", F.lit(1.0)).alias("plan"))


@query("win8_last_good", f"WITH {PLANS} SELECT cycle, frame, last_value(plan IGNORE NULLS) OVER (PARTITION BY cycle ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM plans")
def last_good(spark, d):
    return S.last_known(plans(spark, d), ["cycle"], "frame", "plan").select("cycle", "frame", "known")


@query("prj38_base_frame", f"WITH {V.EXPOSURES_SQL}, b AS (SELECT cycle, list(iso - 500 ORDER BY frame) AS b FROM exposures GROUP BY cycle) SELECT cycle, CAST(list_position(list_transform(b, lambda x: abs(x)), list_min(list_transform(b, lambda x: abs(x)))) - 1 AS INTEGER) AS base FROM b")
def base_frame(spark, d):
    b = V.exposures(spark, d).groupBy("cycle").agg(F.sort_array(F.collect_list(F.struct("frame", (F.col("iso") - 500).alias("b"))))["b"].alias("b"))
    return b.select("cycle", S.base_frame(F.col("b")).alias("base"))


@query("prj39_stops", f"WITH {V.EXPOSURES_SQL} SELECT cycle, frame, round(log2(iso / 100), 9) AS stops, round(pow(2.0::DOUBLE, log2(iso / 100)), 9) AS ratio FROM exposures")
def stops(spark, d):
    s = F.log2(F.col("iso") / 100)
    return V.exposures(spark, d).select("cycle", "frame", F.round(s, 9).alias("stops"), F.round(F.pow(F.lit(2.0), s), 9).alias("ratio"))


@query("jn13_governing_palette", f"WITH {V.EXPOSURES_SQL}, c AS (SELECT cycle, max(iso) AS seed, bool_and(t > 0) AS ok FROM exposures GROUP BY cycle) SELECT cycle, first_value(CASE WHEN ok THEN seed END IGNORE NULLS) OVER (PARTITION BY cycle // 16 ORDER BY cycle) AS governing FROM c")
def governing_palette(spark, d):
    """The first good cycle's seed of a burst governs it and all later ones."""
    c = V.exposures(spark, d).groupBy("cycle").agg(F.max("iso").alias("seed"), F.bool_and(F.col("t") > 0).alias("ok"))
    w = Window.partitionBy(F.floor(F.col("cycle") / 16)).orderBy("cycle").rangeBetween(Window.unboundedPreceding, 0)
    return c.select("cycle", F.first(F.when(F.col("ok"), F.col("seed")), ignorenulls=True).over(w).alias("governing"))


@query("flt8_good_cycles", f"WITH {V.EXPOSURES_SQL} SELECT cycle, CAST(count(*) AS BIGINT) AS frames FROM exposures GROUP BY cycle HAVING bool_and(t > 0) AND count(*) = 4")
def good_cycles(spark, d):
    c = V.exposures(spark, d).groupBy("cycle").agg(F.count(F.lit(1)).alias("frames"), F.bool_and(F.col("t") > 0).alias("ok"))
    return c.filter("ok AND frames = 4").orderBy("cycle").select("cycle", "frames")


@query("str5_failure_budget", f"WITH {V.EXPOSURES_SQL}, c AS (SELECT cycle, bool_and(t > 0) AS ok FROM exposures GROUP BY cycle) SELECT cycle // 16 AS burst, CAST(count(*) FILTER (ok) AS BIGINT) AS good, count(*) FILTER (ok) >= 14 AS passed FROM c GROUP BY 1")
def failure_budget(spark, d):
    c = V.exposures(spark, d).groupBy("cycle").agg(F.bool_and(F.col("t") > 0).alias("ok"))
    return c.groupBy(F.floor(F.col("cycle") / 16).alias("burst")).agg(F.count_if("ok").alias("good"), (F.count_if("ok") >= 14).alias("passed"))
