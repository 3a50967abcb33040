"""Lattice views over ordinary tables, and the same views as SQL.

There are no sensor files among the tables that queries run on, so mosaics,
index streams, exposure records and stage timings are derived from them by
fixed arithmetic. Each view is a plan, never a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 32
BLACK, WHITE = 528, 4095


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders whose lines make up a cycle, so that cycles grow in number with the table.
CYCLE_ORDERS = 2048


def mosaic(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """cycle, frame, y, x, dn: sensor counts of four-frame brackets."""
    dn = BLACK + F.round(F.col("l_extendedprice") * 100).cast("long") % 3568
    keyed = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / CYCLE_ORDERS).alias("cycle"),
        ((F.col("l_linenumber") - 1) % 4).cast("long").alias("frame"),
        (F.col("l_partkey") % side).alias("y"),
        (F.col("l_suppkey") % side).alias("x"),
        dn.alias("dn"),
    )
    return keyed.groupBy("cycle", "frame", "y", "x").agg(F.floor(F.sum("dn") / F.count("dn")).alias("dn"))


def mosaic_sql(side: int = SIDE) -> str:
    return f"""mosaic AS (SELECT l_orderkey // {CYCLE_ORDERS} AS cycle, CAST((l_linenumber - 1) % 4 AS BIGINT) AS frame,
  l_partkey % {side} AS y, l_suppkey % {side} AS x,
  CAST(floor(sum({BLACK} + CAST(round(l_extendedprice * 100) AS BIGINT) % 3568) / count(*)) AS BIGINT) AS dn
  FROM lineitem GROUP BY ALL)"""


def lattice(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """cycle, y, x, v: every place of a square lattice filled (places without rows hold 0)."""
    seen = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % side).alias("y"), (F.col("l_orderkey") % side).alias("x")).agg(
        (F.sum(F.col("l_linenumber").cast("long") * 37 + F.col("l_suppkey")) % 4096).alias("v")
    )
    places = spark.range(side * side).select(F.lit(0).cast("long").alias("cycle"), F.floor(F.col("id") / side).alias("y"), (F.col("id") % side).alias("x"))
    return places.join(F.broadcast(seen), ["y", "x"], "left").select("cycle", "y", "x", F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def lattice_sql(side: int = 64) -> str:
    return f"""seen AS (SELECT l_partkey % {side} AS y, l_orderkey % {side} AS x, CAST(sum(CAST(l_linenumber AS BIGINT) * 37 + l_suppkey) % 4096 AS BIGINT) AS v FROM lineitem GROUP BY ALL),
lattice AS (SELECT CAST(0 AS BIGINT) AS cycle, CAST(i // {side} AS BIGINT) AS y, CAST(i % {side} AS BIGINT) AS x, coalesce(v, 0) AS v
  FROM range({side * side}) r(i) LEFT JOIN seen ON seen.y = i // {side} AND seen.x = i % {side})"""


def index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, pos, moment, idx: palette indices in time order per series."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), F.col("event_id").alias("pos"), F.col("ts").alias("moment"), (F.round(F.col("value") * 100).cast("long") % 256).alias("idx")
    )


INDEX_SQL = "index_stream AS (SELECT user_id AS series, event_id AS pos, ts AS moment, CAST(round(value * 100) AS BIGINT) % 256 AS idx FROM events)"


#: Numbers of brackets that a customer's cycles are told apart by.
BRACKETS = 1 << 20


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle, frame, t, iso, f_number: a customer's orders in turn, four to a bracket (the last may be short); some without metadata.

    cycle is customer * BRACKETS + bracket, so bursts of 16 cycles lie within one customer.
    """
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    k = F.col("o_orderkey")
    shots = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("o_custkey"), nth.cast("long").alias("nth"),
        F.when(k % 97 == 0, 0.0).otherwise(1.0 / F.pow(F.lit(2.0), (k % 11).cast("double"))).alias("t"),
        (100.0 * (1 + k % 13)).alias("iso"),
        F.lit(1.78).alias("f_number"),
    )
    return shots.select((F.col("o_custkey") * BRACKETS + F.floor(F.col("nth") / 4)).alias("cycle"), (F.col("nth") % 4).alias("frame"), "t", "iso", "f_number")


EXPOSURES_SQL = f"""exposures AS (SELECT o_custkey * {BRACKETS} + nth // 4 AS cycle, nth % 4 AS frame, t, iso, f_number FROM (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth,
  CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / pow(CAST(2 AS DOUBLE), o_orderkey % 11) END AS t,
  CAST(100 AS DOUBLE) * (1 + o_orderkey % 13) AS iso, CAST(1.78 AS DOUBLE) AS f_number FROM orders))"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage, call, moment, ms: stage timings."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("call"), F.col("ts").alias("moment"), F.col("value").alias("ms"))


STAGES_SQL = "stages AS (SELECT event_type AS stage, event_id AS call, ts AS moment, value AS ms FROM events)"


def probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(palette, targets) of Q16 triples: the first 256 vectors, and all the others."""
    q = lambda i: F.floor(F.col("embedding")[i].cast("double") * 65536 + 0.5)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", q(0).alias("l"), q(1).alias("a"), q(2).alias("b"))
    palette = rows.filter("vec_id < 256").select(F.col("vec_id").alias("idx"), "l", "a", "b")
    return palette, rows.filter("vec_id >= 256").select(F.col("vec_id").alias("pos"), "l", "a", "b")


PROBES_SQL = """vectors AS (SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 65536 + 0.5) AS BIGINT) AS l,
  CAST(floor(CAST(embedding[2] AS DOUBLE) * 65536 + 0.5) AS BIGINT) AS a, CAST(floor(CAST(embedding[3] AS DOUBLE) * 65536 + 0.5) AS BIGINT) AS b FROM embeddings),
palette AS (SELECT vec_id AS idx, l, a, b FROM vectors WHERE vec_id < 256),
targets AS (SELECT vec_id AS pos, l, a, b FROM vectors WHERE vec_id >= 256)"""
