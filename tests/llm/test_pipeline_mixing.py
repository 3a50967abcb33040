import hashlib
import math
from collections import Counter

import corpus_pipeline as c


def brute(rows, temperature=0.7, seed=17):
    """Copies of each doc_id from md5 and the inverse of the Poisson distribution, in plain Python."""
    n = Counter(source for _, source in rows)
    weight = {s: k**temperature for s, k in n.items()}
    out = {}
    for i, source in rows:
        rate = weight[source] / sum(weight.values()) * len(rows) / n[source]
        u = int(hashlib.md5(f"{seed}:count:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        below = p
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        out[i] = k
    return {i: k for i, k in out.items() if k}


def test_mixing_stage_makes_the_counts_of_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["source"]) for r in docs.select("doc_id", "source").collect()])
    stage = dict(c.STAGES)["mixing"]
    got = Counter(r["doc_id"] for r in stage(spark, docs, sf).select("doc_id").collect())
    assert got == want and len(set(want.values())) > 1
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in stage(spark, docs, sf).collect())


def test_a_copied_input_would_not_pass(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    assert brute([(r["doc_id"], r["source"]) for r in rows]) != Counter(r["doc_id"] for r in rows)
