"""From documents to packed training sequences, in stages over whole tables.

Each stage takes what the one before it kept, written and read again, so a
lost executor or a restart costs one stage at most, and each begins by deleting
the intermediate tables of the one before. All but the last return
the columns of ``documents``.

1. toxicity: documents whose score reaches the threshold go.
2. exact dedup: of texts equal but for the case of A-Z, the row of largest id stays.
3. near dedup: of each component of texts that share 0.8 of their five-word
   shingles or more, the document of smallest id stays.
4. mixing: sources move to their target weights by Poisson replication.
5. packing: documents become sequences of at most 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rungwise.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from rungwise.llm._shared import MADE, discard, materialize, pick, release_shuffles


#: Intermediate tables of the stage before; its output is written once the next stage begins.
_LEFT: list[str] = []


def stage(function):
    """A stage that first deletes what the one before put aside."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, [p for p in _LEFT if p in MADE])
        before = len(MADE)
        out = function(spark, docs, sf_dir)
        _LEFT[:] = MADE[before:]
        return out

    run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pick(exact_dedup.keep_one(docs), *docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pick(jaccard_join.keep_one_of_each(docs, shingle=5, num=80, den=100), *docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pick(mixing.mix(docs), *docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the scores, the state or the packing; tests hold every stage against plain forms in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _LEFT.clear()
    for name, function in STAGES[:-1]:
        docs = materialize(function(spark, docs, sf_dir), f"stage-{name}")
        release_shuffles(spark)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _LEFT.clear()  # the result reads the last stage's tables whenever its caller likes
    return packed
