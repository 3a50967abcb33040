"""Entry points: ``python -m rungwise COMMAND PATH ...``.

query    a registered query (``--name``) over a folder of tables
verify   whether a bundle's files are those of its manifest (``--tables`` names its tables)
render   raw files to fixed-point colours of cells of ``--cell`` sites
noise    raw files to the low envelope of noise by brightness
abfuse   brackets of four raw files, in order of path: both fusions, and how far apart they are
cube     containers to a report of their sets, after their integrity
battle   index streams (series, pos, moment, idx) to balance, entropy and churn
watch    metric lines that have arrived so far

Each prints its rows, or writes them as Parquet to ``--out``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.functions import colour as C
from rungwise.operators import bins as B
from rungwise.operators import exposure as E
from rungwise.operators import indexstats as I
from rungwise.operators import statistics as S
from rungwise.sources import bundles, packages, rawfile


def query(spark: SparkSession, path: str, name: str) -> DataFrame:
    from rungwise import registry

    return registry.queries()[name](spark, path)


def verify(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    return bundles.intact(spark, path, tables)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return rawfile.decoded(packages.read_binary(spark, path))


def _samples(raw: DataFrame) -> DataFrame:
    """path, y, x, v: counts between black and white."""
    levels = raw.filter("status = 0").select("path", "black", "white")
    return rawfile.long_samples(raw, ["path"]).join(levels, "path").select("path", "y", "x", ((F.col("dn") - F.col("black")) / (F.col("white") - F.col("black"))).alias("v"))


def render(spark: SparkSession, path: str, cell: int = 4) -> DataFrame:
    cells = B.means(B.cell_sums(_samples(_raw(spark, path)), ["path"], cell, "v"), ["path"])
    lab = C.to_oklab(cells.filter("r > 0 AND g > 0 AND b > 0"), ["r", "g", "b"], ["lab_l", "lab_a", "lab_b"])
    return lab.select("path", "cy", "cx", *[C.quantised(F.col(f"lab_{c}")).alias(c) for c in "lab"])


def noise(spark: SparkSession, path: str, block: int = 8, buckets: int = 4) -> DataFrame:
    rows = S.second_differences(_samples(_raw(spark, path)), ["path", "y"], "x", "v")
    at = [F.floor(F.col(c) / block).alias(f"r{c}") for c in "yx"]
    blocks = rows.groupBy("path", *at).agg(F.avg("v").alias("mean"), (F.sum(F.col("d2") * F.col("d2")) / 6 / F.count("d2")).alias("var")).filter("var IS NOT NULL")
    ranked = S.rank_buckets(blocks.withColumn("key", F.struct("mean", "ry", "rx")), ["path"], "key", buckets)
    return S.ordered_pick(ranked, ["path", "bucket"], "var", 0.1, "p10")


def abfuse(spark: SparkSession, path: str) -> DataFrame:
    raw = _raw(spark, path).filter("status = 0")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    nth = F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1  # files of one folder
    shots = raw.withColumn("folder", folder).withColumn("nth", nth).select(
        "path", F.concat_ws("#", "folder", F.floor(F.col("nth") / 4)).alias("cycle"), (F.col("nth") % 4).cast("long").alias("frame"),
        F.col("exposure_time").alias("t"), "iso", "f_number", F.coalesce("noise_s", F.lit(1e-4)).alias("s"), F.coalesce("noise_o", F.lit(1e-6)).alias("o"),
    )
    shots = E.relative_exposure(shots).select("path", "cycle", "frame", F.col("rel_e").alias("e"), "s", "o")
    seen = _samples(raw).withColumnRenamed("v", "y_obs").join(shots, "path")
    keys = ["cycle", "y", "x"]
    both = E.fuse_likelihood(seen, keys).join(E.fuse_heuristic(seen, keys).withColumnRenamed("fused", "other"), keys)
    apart = F.abs(F.col("fused") - F.col("other"))
    return both.groupBy("cycle").agg(F.count(F.lit(1)).alias("places"), F.avg(apart).alias("mean_apart"), F.max(apart).alias("most_apart"))


def cube(spark: SparkSession, path: str) -> DataFrame:
    files = packages.read_binary(spark, path)
    sets = packages.containers(files).groupBy("path", "set_id").agg(F.count(F.lit(1)).alias("bins"), F.avg("l_mean").alias("lightness"), F.avg("a_mean").alias("a"), F.avg("b_mean").alias("b"))
    return packages.integrity(files).select("path", "version", "sets", "checksum_ok").join(sets, "path", "left")


def battle(spark: SparkSession, path: str) -> DataFrame:
    stream = spark.read.parquet(path)
    return I.balance(stream, ["series"]).select("series", "n", "chi2", "entropy").join(I.churn(stream, ["series"], ["moment", "pos"]), "series")


def watch(spark: SparkSession, path: str) -> DataFrame:
    return packages.metrics(spark.read.text(path))


COMMANDS = {"query": query, "verify": verify, "render": render, "noise": noise, "abfuse": abfuse, "cube": cube, "battle": battle, "watch": watch}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m rungwise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("path")
    parser.add_argument("--name")
    parser.add_argument("--tables", nargs="*", default=["frames"])
    parser.add_argument("--cell", type=int, default=4)
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    more = {"query": {"name": args.name}, "verify": {"tables": args.tables}, "render": {"cell": args.cell}}.get(args.command, {})
    spark = SparkSession.builder.appName(f"rungwise-{args.command}").getOrCreate()
    rows = COMMANDS[args.command](spark, args.path, **more)
    rows.write.mode("errorifexists").parquet(args.out) if args.out else rows.show(1000, truncate=False)


if __name__ == "__main__":
    main()
