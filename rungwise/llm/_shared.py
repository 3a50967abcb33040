"""Helpers that several operators of this subpackage share.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which every executor sees, so a lost executor costs
a re-read and nothing else.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of intermediate tables made by this process, in order.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only on a single machine that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rungwise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    MADE.append(f"{shared_dir(spark)}/rungwise/{tag}-{uuid.uuid4().hex}")
    return MADE[-1]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables; frames that read them must be done with."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's cleaner drop shuffle files of finished jobs now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra or clashing ones never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A table of narrow rows, marked for broadcast if it has at most ``most`` of them (counted here)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches of texts stay small in the workers, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, size)


def by_bytes(batch: pa.RecordBatch, column: int, limit: int):
    """Slices of a batch whose binary or string column holds about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths, dtype=np.int64) - 1) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)
