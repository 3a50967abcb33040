import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rungwise.llm import exact_dedup as m


def lowered(t):
    return re.sub("[A-Z]", lambda x: x.group().lower(), t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return {i: (max(groups[lowered(t)]), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows}


def test_against_brute_force(table, corpus):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["digest"]) for r in m.exact_dedup(table(corpus)).collect()}
    assert got == brute(corpus)


def test_colliding_digests_are_told_apart_by_bytes(table, corpus):
    weak = lambda whole: F.substring(m.sha256_hex(whole), 1, 1)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in m.exact_dedup(table(corpus), digest=weak).collect()}
    assert got == {k: v[:2] for k, v in brute(corpus).items()}


def test_repeats_nulls_and_empty_tables(table):
    got = m.exact_dedup(table([(1, "A"), (1, "a"), (2, "b"), (None, "B"), (None, None), (5, "")])).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 3
    assert {r["keep_id"] for r in got} == {1, 2, 5}
    assert m.exact_dedup(table([])).count() == 0


def test_a_later_arrival_meets_the_state_of_earlier_ones(spark, table, tmp_path):
    store = f"file://{tmp_path}/store"
    first, second = [(1, "A b"), (2, "c"), (9, "a B")], [(5, "C"), (3, "a b"), (6, "new")]
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in m.exact_dedup(table(first), store=store).collect()} == {i: v[:2] for i, v in brute(first).items()}
    got = m.exact_dedup(table(second), store=store).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["digest"]) for r in got} == brute(first + second)
    assert m.exact_dedup(table([]), store=store).count() == 6
    # locators lead to the bytes
    rows = {(r["arrival"], r["uid"]): r["whole"] for r in spark.read.parquet(f"{store}/rows").collect()}
    texts = dict(first + second)
    assert {r["doc_id"]: rows[r["arrival"], r["uid"]] for r in got} == {i: lowered(t) for i, t in texts.items()}


def test_large_groups_long_texts_and_names_of_its_own(table, monkeypatch):
    monkeypatch.setattr(m, "GROUP", 2)
    long = "word " * 200_000
    rows = [(i, "Same text") for i in range(40)] + [(50, long), (51, long.upper()), (52, long + "x")]
    df = table(rows).toDF("doc_id", "text", *[f"x{i}" for i in range(len(table(rows).columns) - 4)], "k_digest", "K_TEXT")
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["digest"]) for r in m.exact_dedup(df).collect()} == brute(rows)
    kept = m.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {39, 51, 52}


def test_native_plan(table):
    plan = m.exact_dedup(table([(1, "a"), (2, "A")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_keep_one_keeps_columns(table, same):
    df = table([(1, "A b"), (4, "a B"), (2, "c"), (2, "c"), (None, None)])
    got = m.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got.collect() if r["text"]) == [(False, 2, "c"), (False, 4, "a B")]
    assert got.count() == 3


@pytest.mark.parametrize("name", ["op9_exact_dedup"])
def test_sql_twin(spark, sf, duck, same, name):
    from rungwise.llm import registry

    same(registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).df())
