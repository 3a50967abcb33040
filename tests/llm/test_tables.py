import math

import pytest
from pyspark.sql import functions as F

from rungwise.llm import fixity, licences, mixing

# ---------------------------------------------------------------- mixing


def test_poisson_inversion(spark):
    rows = [(i / 500, r) for i in range(500) for r in (0.1, 1.0, 7.5)]
    df = spark.createDataFrame(rows, "u double, rate double").withColumn("k", F.size(F.filter(mixing.poisson_cdf(F.col("rate")), lambda c: c <= F.col("u"))))
    for u, rate, k in df.collect():
        cdf = [math.exp(-rate) * sum(rate**j / math.factorial(j) for j in range(n + 1)) for n in range(60)]
        assert k == sum(c <= u for c in cdf)


def test_shares_follow_the_weights_and_rows_stay_whole(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a" if i % 4 else "b" if i % 8 else None, "x") for i in range(8000)], "doc_id long, text string, source string, mix_key string")
    got = mixing.mix(docs, weights={"a": 1.0, "b": 1.0, None: 2.0})
    assert got.columns == ["doc_id", "text", "source", "mix_copy", "mix_key"]
    share = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(share[s] / 8000 - w) < 0.03 for s, w in (("a", 0.25), ("b", 0.25), (None, 0.5)))
    assert got.filter(F.col("text") != F.concat(F.lit("t"), F.col("doc_id"))).count() == 0
    assert got.groupBy("doc_id").agg((F.max("mix_copy") == F.count("*")).alias("ok")).filter("NOT ok").count() == 0
    again = mixing.mix(docs.repartition(13), weights={"a": 1.0, "b": 1.0, None: 2.0})
    assert got.exceptAll(again).count() == 0 and mixing.mix(docs, seed=18).exceptAll(mixing.mix(docs)).count() > 0


def test_mixing_edges(table):
    df = table([(1, None), (1, None), (None, "x"), (2, "")])
    got = mixing.mix(df, size=4.0)
    counts = [r["count"] for r in got.filter("doc_id = 1").groupBy("mix_copy").count().collect()]
    assert all(c == 2 for c in counts)
    assert mixing.mix(table([])).count() == 0
    assert mixing.mix(df, weights={"none": 1.0}).count() == 0
    dotted = df.withColumnRenamed("lang", "a.b").withColumnRenamed("rate", "row")
    assert mixing.mix(dotted).columns == [*dotted.columns, "mix_copy", "mix_key"]
    long = "long text " * 200_000
    assert {r["text"] for r in mixing.mix(table([(1, long), (2, long)]), size=20.0).collect()} == {long}


# ---------------------------------------------------------------- fixity


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://e/{i}", h, 1) for i, h in rows], "page_id long, url string, html string, file long")


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"<p>{i}</p>" * (i % 5 + 1)) for i in range(3300)]
    bad = dict(rows)
    bad[7] = "~" + bad[7][1:]
    bad[2500] = bad[2500][:-1]
    del bad[3299]
    bad[3300] = "new"
    got = {r["page_id"]: r["problem"] for r in fixity.audit(pages(spark, rows), pages(spark, list(bad.items()))).collect()}
    want = {7: "content", 2500: "content", **{i: "moved" for i in range(2501, 3000)}, 3299: "missing in replica", 3300: "missing in primary"}
    assert got == want
    assert fixity.audit(pages(spark, rows), pages(spark, rows)).count() == 0


def test_audit_edges(spark):
    one = pages(spark, [(1, None), (1, "a"), (None, "x"), (5, "")])
    assert fixity.audit(one, one).count() == 0
    assert fixity.audit(pages(spark, []), pages(spark, [])).count() == 0
    got = fixity.audit(one, pages(spark, []))
    assert {(r["page_id"], r["problem"]) for r in got.collect()} == {(1, "missing in replica"), (5, "missing in replica"), (None, "missing in replica")}
    assert fixity.audit(pages(spark, [(1, "a"), (1, "b")]), pages(spark, [(1, "b"), (1, "a")])).count() == 0


def test_rows_without_an_id_are_audited_too(spark):
    rows = [(None, "a"), (None, "b"), (3, "c")]
    assert fixity.audit(pages(spark, rows), pages(spark, rows[::-1])).count() == 0
    got = fixity.audit(pages(spark, rows), pages(spark, [(None, "a"), (None, "x"), (3, "c")])).collect()
    assert [(r["page_id"], r["file"], r["problem"]) for r in got] == [(None, None, "content")]


def test_very_long_pages_and_empty_ones(spark):
    long = "<p>long</p>" * 300_000
    rows = [(1, long), (2, ""), (3, None), (4, "x")]
    got = fixity.audit(pages(spark, rows), pages(spark, [(1, long[:-1] + "!"), *rows[1:]])).collect()
    assert [(r["page_id"], r["problem"]) for r in got] == [(1, "content")]


def test_only_branches_that_differ_are_compared(spark):
    rows = [(i, "x") for i in range(2000)]
    a, b = fixity.records(pages(spark, rows)), fixity.records(pages(spark, [(i, "y" if i == 1234 else h) for i, h in rows]))
    (in_a, _), (in_b, _) = fixity.tree(a), fixity.tree(b)
    top = fixity._differing(in_a[-1], in_b[-1], ["file", "node"], None)
    assert [(r["file"], r["node"]) for r in top.collect()] == [(1, 0)]
    assert fixity._differing(in_a[-2], in_b[-2], ["file", "node"], top).count() == 1


# ---------------------------------------------------------------- licences


def test_notices_and_texts_are_found(table):
    mit = dict(licences.TEMPLATES)["MIT"]
    rows = [
        (1, "some prose here\nReleased under the MIT License.\nmore prose"), (2, mit.replace("Software", "SOFTWARE,  ").upper()), (3, "Intro\n\n" + mit.replace(". ", ".\n") + "\n\nOutro of the file"),
        (4, "nothing to see " * 40), (5, None), (6, ""), (7, "Licensed under the Apache License, Version 2.0"), (None, "MIT"),
    ]
    got = {r["doc_id"]: r for r in licences.scan(table(rows)).collect()}
    assert [got[i]["licence"] for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["MIT-notice", "MIT", "MIT", None, None, None, "Apache-2.0-notice", None]
    assert got[1]["unit"] == "line" and got[3]["unit"] == "paragraph" and got[2]["unit"] == "text" and got[7]["dice"] == 1.0
    assert licences.scan(table([])).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_size_bounds_lose_nothing(corpus, threshold):
    extra = [t for _, t in licences.TEMPLATES] + [t[len(t) // 4 :] for _, t in licences.TEMPLATES] + [t + " and some more words at the end" for _, t in licences.TEMPLATES]
    scanner = licences.Scanner(threshold=threshold)
    for text in [t or "" for _, t in corpus] + extra:
        words = licences.words_of(text)
        have = licences.bigrams(words)
        full = [(2 * len(have & s) / (len(have) + len(s)), -k) for _, s, k in scanner.sets if have]
        best = max(full, default=(0, 0))
        got = scanner.best(words)
        assert (got is None and best[0] < threshold) or (got[0], -got[1]) == best
