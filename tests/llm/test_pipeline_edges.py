"""Every stage of the pipeline on rows that are not ordinary."""

import corpus_pipeline as c
from pyspark.sql import functions as F

from rungwise.llm._shared import materialize


def through(spark, sf, docs):
    kept = {}
    for name, stage in c.STAGES:
        docs = materialize(stage(spark, docs, sf), f"edge-{name}")
        kept[name] = docs
    return kept


def test_nulls_repeats_long_texts_and_clashing_columns(spark, sf, table):
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, "One two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, " \n "), (6, long), (7, long + " tail"), (8, "same row"), (8, "same row"), (None, "no id here at all"), (None, None)]
    docs = table(rows).withColumnRenamed("run", "a.b")
    kept = through(spark, sf, docs)
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert kept[name].columns == docs.columns
    assert kept["toxicity"].count() == len(rows)
    dedup = sorted((r["doc_id"] or 0, (r["text"] or "").strip()[:8]) for r in kept["exact_dedup"].collect())
    assert dedup == sorted([(2, "one two "), (4, ""), (5, ""), (6, "word0x0 "), (7, "word0x0 "), (8, "same row"), (0, "no id he")])
    near = {r["doc_id"] for r in kept["near_dedup"].collect()}
    assert near == {None, 2, 4, 5, 6, 8}
    packed = kept["packing"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert {r["doc_id"] for r in packed.collect()} <= near


def test_empty_tables(spark, sf, table):
    kept = through(spark, sf, table([]))
    assert all(df.count() == 0 for df in kept.values())
