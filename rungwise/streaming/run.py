"""Running streams to the end of what is there, with state in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a temporary one only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rungwise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/rungwise/{tag}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; ``files_per_trigger`` bounds what is in flight."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern of one match: a plain path to a single file is not taken for a stream
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def appended(stream: DataFrame, tag: str) -> DataFrame:
    """All rows the stream appends until its source is exhausted."""
    spark = stream.sparkSession
    out = shared_path(spark, tag)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", shared_path(spark, f"{tag}-state")).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def completed(stream: DataFrame, tag: str) -> DataFrame:
    """The last complete result of an aggregating stream."""
    spark = stream.sparkSession
    out = shared_path(spark, tag)
    last: list[str] = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{batch}")
        last[:] = [f"{out}/{batch}"]

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, f"{tag}-state")).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
