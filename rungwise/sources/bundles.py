"""Result bundles: partitioned tables, a manifest of digests last, and a small preview page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write(tables: dict[str, DataFrame], path: str, by: list[str]) -> None:
    """Each table below the bundle's folder, partitioned; the manifest of all files comes last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
    manifest(spark, path, list(tables)).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """name, bytes and digest of each file of the bundle's tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{path}/{n}" for n in names])
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def intact(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whether the files are those of the manifest."""
    now, then = manifest(spark, path, names), spark.read.parquet(f"{path}/manifest")
    return now.exceptAll(then).unionByName(then.exceptAll(now)).agg((F.count(F.lit(1)) == 0).alias("intact"))


def html_row(*cells: Column) -> Column:
    """A table row of escaped cells."""
    safe = [F.regexp_replace(F.regexp_replace(c.cast("string"), "&", "&amp;"), "<", "&lt;") for c in cells]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), s, F.lit("</td>")) for s in safe], F.lit("</tr>"))


def page(rows: DataFrame, order: list[str]) -> str:
    """A page of at most a thousand rows of a small report."""
    body = "".join(r["row"] for r in rows.orderBy(*order).limit(1000).select("row").collect())
    return f"<!doctype html><meta charset=utf-8><table>{body}</table>"


def narrative(lines: DataFrame, order: list[str], most: int = 4000) -> DataFrame:
    """The latest lines of a log, capped as the log itself is."""
    return lines.orderBy(*[F.desc(c) for c in order]).limit(most)
