import numpy as np
from test_jaccard_join import brute as near_brute
from test_packing import valid

from rungwise.llm import toxicity
from rungwise.llm._shared import materialize


def test_stages_take_effect(spark, sf, table):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in c.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), f"test-{name}")
        out[name] = before.toPandas(), docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    before, after = out["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    full = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r["doc_id"] for r in toxicity.score(full, toxicity.train(full, labels)).filter("predicted = 1").collect()}
    assert set(after["doc_id"]) == set(before["doc_id"]) - rejected and rejected
    before, after = out["exact_dedup"]
    lower = before["text"].fillna("").str.translate({i: i + 32 for i in range(65, 91)})
    assert set(after["doc_id"]) == set(before.groupby(lower)["doc_id"].max())
    before, after = out["near_dedup"]
    found = near_brute(list(zip(before["doc_id"], before["text"])), 5, 80, 100)
    assert set(after["doc_id"]) == {i for i, (_, root) in found.items() if i == root}
    before, after = out["mixing"]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and 0.6 * len(before) < len(after) < 1.6 * len(before)
    before, after = out["packing"]
    assert valid(after.to_dict("records"), 4096) >= np.ceil(after["length"].sum() / 4096)
    assert sorted(after[after["piece"] == 0]["doc_id"]) == sorted(before["doc_id"])


def test_run_and_contract(spark, sf):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and c.ORACLE_SQL is None
    assert c.run(spark, sf).count() > 0
