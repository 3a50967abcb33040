"""Queries that run streams over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.registry import query
from rungwise.streaming import operators as O
from rungwise.streaming.run import appended, completed, source


def ticks(spark, d, files_per_trigger=None):
    """series, pos, us, idx, ok, ts, kind, value as a stream."""
    e = source(spark, f"{d}/events.parquet", files_per_trigger)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("series"), F.col("event_id").alias("pos"), F.unix_micros(ts).alias("us"), (F.round(F.col("value") * 100).cast("long") % 256).alias("idx"),
        (F.col("event_id") % 9 != 0).alias("ok"), ts.alias("ts"), F.col("event_type").alias("kind"), "value",
    )


T = "ticks AS (SELECT user_id AS series, event_id AS pos, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) % 256 AS idx, event_id % 9 <> 0 AS ok, ts, event_type AS kind, value FROM events)"
GAP = 6 * 3600 * 1_000_000


@query("str8_throttle", f"WITH RECURSIVE {T}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, pos) AS rn FROM ticks), r AS (SELECT series, pos, us, rn, us AS last, true AS passed FROM o WHERE rn = 1 UNION ALL SELECT o.series, o.pos, o.us, o.rn, CASE WHEN o.us - r.last >= {GAP} THEN o.us ELSE r.last END, o.us - r.last >= {GAP} FROM r JOIN o ON o.series = r.series AND o.rn = r.rn + 1) SELECT series, pos, us FROM r WHERE passed")
def throttle(spark, d):
    return appended(O.throttled(ticks(spark, d), "series", "us", "pos", GAP), "throttle")


@query("str9_monotone", f"WITH {T}, r AS (SELECT series, pos, us, max(us) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM ticks) SELECT series, pos FROM r WHERE shown IS NULL OR us > shown")
def monotone(spark, d):
    return appended(O.monotone(ticks(spark, d), "series", "us", "pos"), "monotone")


@query("str10_brackets", f"WITH {T}, o AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY us, pos) - 1) // 4 AS nth FROM ticks) SELECT series, nth, CAST(sum(idx) AS BIGINT) AS total FROM o GROUP BY 1, 2 HAVING count(*) = 4")
def brackets(spark, d):
    return appended(O.brackets(ticks(spark, d), "series", "us", "pos", "idx"), "brackets")


@query("str4_first_seed", f"WITH {T} SELECT series, pos, first_value(idx) OVER (PARTITION BY series ORDER BY us, pos) AS governing FROM ticks")
def first_seed(spark, d):
    return appended(O.first_seed(ticks(spark, d), "series", "us", "pos", "idx"), "seed")


@query("str7_feedback", f"WITH {T} SELECT series, pos, coalesce(last_value(CASE WHEN ok THEN idx END IGNORE NULLS) OVER (PARTITION BY series ORDER BY us, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS plan FROM ticks")
def feedback(spark, d):
    s = ticks(spark, d).withColumn("plan_in", F.when(F.col("ok"), F.col("idx")))
    return appended(O.feedback(s, "series", "us", "pos", "plan_in", -1), "feedback")


@query("str11_running_churn", f"WITH {T}, l AS (SELECT *, lag(idx) OVER (PARTITION BY series ORDER BY us, pos) AS b FROM ticks) SELECT series, pos, CAST(sum(CASE WHEN b IS NOT NULL AND b <> idx THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY us, pos) AS BIGINT) AS churn FROM l")
def running_churn(spark, d):
    return appended(O.running_churn(ticks(spark, d), "series", "us", "pos", "idx"), "churn")


@query("str5_alarms", f"WITH {T}, c AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY us, pos) AS bad FROM ticks) SELECT series, pos, CAST(bad AS BIGINT) AS failed FROM c WHERE NOT ok AND bad = 3")
def alarms(spark, d):
    return appended(O.failures(ticks(spark, d), "series", "us", "pos", "ok", 2), "alarms")


@query("str1_2_micro_batches", f"WITH {T} SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(idx) AS BIGINT) AS total FROM ticks GROUP BY kind")
def micro_batches(spark, d):
    """A file at a time, as the bound on what is in flight asks; the sums do not depend on it."""
    s = ticks(spark, d, files_per_trigger=1).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"))
    return completed(s, "batches")


@query("str3_ordered_chain", f"WITH {T}, l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, pos) AS nth FROM ticks) SELECT series, CAST(max(nth) AS BIGINT) AS steps, CAST(sum(nth * idx) AS BIGINT) AS chained FROM l GROUP BY series")
def ordered_chain(spark, d):
    """The first value of brackets of one: each key's rows handled strictly in order."""
    got = appended(O.brackets(ticks(spark, d), "series", "us", "pos", "idx", size=1), "chain")
    return got.groupBy("series").agg((F.max("nth") + 1).alias("steps"), F.sum((F.col("nth") + 1) * F.col("total")).alias("chained"))


@query("str6_watchdog", f"WITH {T}, g AS (SELECT series, us, CASE WHEN us - lag(us) OVER (PARTITION BY series ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM ticks), n AS (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT series, min(us) AS start_us, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY series, k")
def watchdog(spark, d):
    s = completed(O.stalled(ticks(spark, d), "series", "ts", "6 hours"), "watchdog")
    return s.select("series", F.unix_micros("start").alias("start_us"), "n")


@query("str12_metrics_tail", "SELECT event_type AS event, event_id AS step FROM events WHERE event_id % 10 <> 3")
def metrics_tail(spark, d):
    """Metric lines as they arrive; broken ones are dropped."""
    s = ticks(spark, d)
    doc = F.to_json(F.struct(F.col("kind").alias("event"), F.col("pos").alias("step")))
    line = s.select(F.when(F.col("pos") % 10 == 3, F.concat(F.lit("{oops"), doc)).otherwise(doc).alias("value"))
    got = line.select(F.from_json("value", "event string, step long").alias("m"), F.try_parse_json("value").isNotNull().alias("ok")).filter("ok").select("m.*")
    return appended(got, "tail")


@query("ext_tumbling_windows", f"WITH {T} SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start_us, kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM ticks GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return completed(O.windowed(ticks(spark, d), "ts", ["kind"], "1 day"), "tumbling")


@query("ext_sliding_windows", f"WITH {T}, w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - INTERVAL (6 * i) HOUR AS s, kind, value FROM ticks, range(4) r(i)) SELECT epoch_us(s) AS start_us, kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM w GROUP BY 1, 2")
def sliding_windows(spark, d):
    return completed(O.windowed(ticks(spark, d), "ts", ["kind"], "1 day", "6 hours"), "sliding")
