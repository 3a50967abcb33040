import math

import pytest
from pyspark.sql import functions as F

from rungwise.llm import mixing


@pytest.mark.parametrize("rate", [0.0, 699.5, 700.5, 800.0, 1200.0, 5000.0])
def test_poisson_inversion_at_large_rates(spark, rate):
    us = [0.0, *((i + 0.37) / 200 for i in range(200))]
    df = spark.createDataFrame([(u, rate) for u in us], "u double, rate double")
    got = {r["u"]: r["k"] for r in df.select("u", F.size(F.filter(mixing.poisson_cdf(F.col("rate")), lambda c: c <= F.col("u"))).alias("k")).collect()}
    cdf, c = [], 0.0
    for k in range(int(rate + 14 * math.sqrt(rate) + 40)):
        c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        cdf.append(c)
    assert {u: sum(c <= u for c in cdf) for u in us if u} == {u: k for u, k in got.items() if u}
    assert got[0.0] <= rate


def test_a_small_source_with_a_large_share_keeps_its_size(spark):
    docs = spark.range(24010).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "few").otherwise("many").alias("source"))
    copies = [r["count"] for r in mixing.mix(docs, weights={"few": 0.5, "many": 0.5}).filter("source = 'few'").groupBy("doc_id").count().collect()]
    assert len(copies) == 10 and len(set(copies)) > 1 and abs(sum(copies) / 10 - 1200.5) < 60


@pytest.mark.parametrize("rate", [800.0, 50_000.0])
def test_counts_over_many_documents_are_poisson(spark, rate):
    """Mean and variance of the counts of 400 documents lie within four standard deviations of the rate."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    low, table = mixing.poisson_table(F.lit(rate))
    got = [r["k"] for r in docs.select((low + F.size(F.filter(table, lambda c: c <= mixing.uniform(mixing.SEED, "count", F.col("doc_id"))))).alias("k")).collect()]
    mean = sum(got) / 400
    assert abs(mean - rate) < 4 * math.sqrt(rate / 400)
    assert abs(sum((k - mean) ** 2 for k in got) / 399 - rate) < 4 * rate * math.sqrt(2 / 399)
