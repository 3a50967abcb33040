"""Ranks, order statistics and trailing frames over keys of any number and size.

A window over a handful of keys would sort each key's rows in one task, however
large the cluster. Here rows are laid out by range of key and order, which
splits a large key over many tasks, numbered where they lie, and written to the
shared folder. What a task has to know of the others (rows of a key before it,
running maxima) is one small row per key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.streaming.run import shared_path

#: Tables of at most so many narrow rows are broadcast.
FEW = 100_000
#: Bits of a number that count rows inside one task.
_BITS = 33


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A table of narrow rows, marked for broadcast if it has at most ``most`` of them (counted here)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stored(df: DataFrame, tag: str) -> DataFrame:
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_out(rows: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(rows with _k, _p, _id in order within task _p; spans: per _k and _p the first _id, rows _c, rows before _off, rows of the key _n)."""
    keyed = rows.withColumn("_k", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0)))
    at = [F.col(o) if isinstance(o, str) else o for o in order]
    laid = keyed.repartitionByRange(F.col("_k"), *at).sortWithinPartitions(F.col("_k"), *at)
    laid = stored(laid.withColumn("_id", F.monotonically_increasing_id()), "laid").withColumn("_p", F.shiftright("_id", _BITS))
    spans = laid.groupBy("_k", "_p").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_k").orderBy("_p")  # a row for each task that holds the key
    return laid, spans.withColumn("_off", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy("_k")))


def ranked(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with their rank _r (from 0) and the number _n of rows, within their key."""
    laid, spans = laid_out(rows, keys, order)
    out = laid.join(few(spans), ["_k", "_p"]).withColumn("_r", F.col("_off") + F.col("_id") - F.col("_first"))
    return out.select(*rows.columns, "_r", "_n")


def picked(rows: DataFrame, keys: list[str], order: list, places) -> DataFrame:
    """Rows at certain ranks of their key: ``places`` maps the column of the key's size to an array of ranks; with _i, the place in that array."""
    laid, spans = laid_out(rows, keys, order)
    wanted = spans.select("_k", "_first", "_off", "_c", F.posexplode(places(F.col("_n"))).alias("_i", "_at"))
    wanted = wanted.filter((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_c")))
    wanted = wanted.select((F.col("_first") + F.col("_at") - F.col("_off")).alias("_id"), F.col("_i").cast("long").alias("_i"))
    return laid.join(few(wanted), "_id").select(*rows.columns, "_i")


def running_max(rows: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """The greatest value of a key's rows up to and including each."""
    laid, spans = laid_out(rows, keys, order)
    tops = laid.groupBy("_k", "_p").agg(F.max(value).alias("_top"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_k", "_p", F.max("_top").over(before).alias("_before"))
    here = Window.partitionBy("_k", "_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    got = laid.withColumn("_here", F.max(value).over(here)).join(few(tops), ["_k", "_p"])
    return got.select(*rows.columns, F.greatest("_here", "_before").alias(out))


def trailing(rows: DataFrame, keys: list[str], order: list, n: int, made) -> DataFrame:
    """Columns made over each row and the n - 1 before it: ``made`` maps a window to named columns.

    A row also goes to every later task whose first rows reach back to it.
    """
    laid, spans = laid_out(rows, keys, order)
    starts = spans.groupBy("_k").agg(F.collect_list(F.struct(F.col("_off").alias("off"), F.col("_p").alias("p"))).alias("_starts"))
    spans = few(spans.select("_k", "_p", "_off", "_first", "_c"))
    placed = laid.join(spans, ["_k", "_p"]).withColumn("_r", F.col("_off") + F.col("_id") - F.col("_first"))
    # only the last rows of a task can reach into another
    last = placed.filter(F.col("_r") >= F.col("_off") + F.col("_c") - (n - 1)).join(few(starts), "_k")
    reach = F.filter("_starts", lambda s: (s["off"] > F.col("_r")) & (s["off"] < F.col("_r") + n))
    halo = last.withColumn("_p", F.explode(F.transform(reach, lambda s: s["p"]))).withColumn("_own", F.lit(False))
    both = placed.withColumn("_own", F.lit(True)).select(*rows.columns, "_k", "_p", "_r", "_own").unionByName(halo.select(*rows.columns, "_k", "_p", "_r", "_own"))
    w = Window.partitionBy("_k", "_p").orderBy("_r").rowsBetween(-(n - 1), 0)
    columns: dict[str, Column] = made(w)
    return both.withColumns(columns).filter("_own").select(*rows.columns, *columns)
