"""Exact deduplication through keyed streaming state (native functions only).

A streaming aggregation keeps one state row per content digest in the
disk-backed store, without expiry: the stable id of the row that stays, its
content locator and the number of rows seen. All of it lies in the folder
``store``; a later call with the same folder is a later arrival, which meets
the state that the earlier ones left. A locator is an arrival's number and a
row's number in it, and names a row of ``store/rows``, where the normalised
bytes are. On hits (rows that meet a digest whose state names another row) the
full bytes are fetched by locator and compared with the kept row's; digests
under which bytes differ are regrouped by the whole text. Members of a large
group are compared in several tasks.

Texts are equal when identical after lower-casing A-Z only.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null id sorts below every other id; of repeated rows with one id
exactly one stays; an empty table gives an empty result; other columns of the
input are never read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import documents, materialize, new_path, pick, release_shuffles


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


ROWS = "doc_id long, arrival int, uid long, digest string, whole string"
#: Members of a group that one task compares with the kept row.
GROUP = 256


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _state_of(spark: SparkSession, store: str) -> DataFrame | None:
    """Run the stateful query over what is new in ``store/rows``; one row per digest seen so far."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        arrivals = spark.readStream.schema(ROWS).parquet(f"{store}/rows")
        state = arrivals.groupBy("digest").agg(
            F.max(F.struct("doc_id", "arrival", "uid")).alias("keep"),
            F.count(F.lit(1)).alias("group_size"),
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{store}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{store}/keys"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, f"{store}/keys"):
        return None
    keep = "keep struct<doc_id: bigint, arrival: int, uid: bigint>"
    table = spark.read.schema(f"digest string, {keep}, group_size bigint, batch bigint").parquet(f"{store}/keys")
    return table.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, digest=sha256_hex, store: str | None = None) -> DataFrame:
    """One row per row of this and all earlier arrivals in ``store``: doc_id, arrival, uid, keep_id, group_size, kept, digest.

    ``digest`` maps the normalised text to a key; whatever it maps together is
    told apart by the bytes afterwards, so a weak one gives the same classes.
    """
    spark = docs.sparkSession
    store = (store or new_path(spark, "dedup")).rstrip("/")
    path = f"{store}/rows"
    arrival = 0
    if _exists(spark, path):
        arrival = (spark.read.schema(ROWS).parquet(path).agg(F.max("arrival")).first()[0] or 0) + 1
    whole = normalised(F.col("text").cast("string"))
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(arrival).alias("arrival"), F.monotonically_increasing_id().alias("uid"), digest(whole).alias("digest"), whole.alias("whole")
    )
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    content = spark.read.schema(ROWS).parquet(path)
    keyed = content.drop("whole")
    state = _state_of(spark, store)
    if state is None:
        return keyed.select("doc_id", "arrival", "uid", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    named = keyed.join(materialize(state, "dedup-keys"), "digest")
    kept = (F.col("arrival") == F.col("keep.arrival")) & (F.col("uid") == F.col("keep.uid"))
    found = named.select("doc_id", "arrival", "uid", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")
    differing = materialize(_differing(content, named), "dedup-differing")
    if differing.limit(1).count() == 0:
        return found
    return _regrouped(content, found, differing)


def _differing(content: DataFrame, named: DataFrame) -> DataFrame:
    """Digests under which a hit's bytes are not those of the row that stays."""
    parts = F.ceil(F.col("group_size") / GROUP).cast("int")
    hits = named.filter("group_size > 1").select("arrival", "uid", "digest", "keep", parts.alias("parts"))
    is_kept = (F.col("arrival") == F.col("keep.arrival")) & (F.col("uid") == F.col("keep.uid"))
    texts = hits.join(content.select("arrival", "uid", "whole"), ["arrival", "uid"])
    others = texts.filter(~is_kept).select("digest", F.pmod("uid", "parts").cast("int").alias("part"), "whole")
    kept = texts.filter(is_kept).select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("whole").alias("kept_whole"))
    return others.join(kept, ["digest", "part"]).filter(F.col("whole") != F.col("kept_whole")).select("digest").distinct()


def _regrouped(content: DataFrame, found: DataFrame, differing: DataFrame) -> DataFrame:
    texts = materialize(content.join(differing, "digest"), "dedup-regroup")
    classes = texts.groupBy("digest", "whole").agg(F.max(F.struct("doc_id", "arrival", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    kept = (F.col("arrival") == F.col("keep.arrival")) & (F.col("uid") == F.col("keep.uid"))
    again = texts.join(classes, ["digest", "whole"]).select("doc_id", "arrival", "uid", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")
    return found.join(differing, "digest", "left_anti").select(*again.columns).unionByName(again)


def _unused(names: list[str], stem: str) -> str:
    """A column name that differs from all others, whatever their case."""
    taken = {n.lower() for n in names}
    while stem in taken:
        stem += "_"
    return stem


def keep_one(docs: DataFrame) -> DataFrame:
    """The input's rows without exact copies, all columns unchanged (null ids included)."""
    of_id, of_digest, of_text = (_unused(docs.columns, x) for x in ("k_id", "k_digest", "k_text"))
    classes = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_digest))
    keyed = docs.withColumn(of_text, sha256_hex(normalised(F.col("text").cast("string"))))
    joined = keyed.join(classes, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(of_text) == F.col(of_digest)), "left_semi")
    return joined.dropDuplicates(["doc_id", of_text]).drop(of_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir))
    out = out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
    release_shuffles(spark)
    return out


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY whole)
"""
