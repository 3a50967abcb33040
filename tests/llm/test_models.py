import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwise.llm import language as L
from rungwise.llm import toxicity as T

CLEAN = "the river runs over old stones and trees stand near houses while birds sing songs of rain".split()
BAD = ["scoundrel", "villainous", "rotter"]


def labelled(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rnd.choice(CLEAN) for _ in range(rnd.randint(3, 40))]
        y = int(i % 4 == 0)
        if y:
            w[rnd.randrange(len(w))] = rnd.choice(BAD)
        rows.append((i, " ".join(w), y))
    return rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rnd = random.Random(8)
    entries = [("abc", False), ("abcde", False), ("bcdea", False), ("aabbccdd", False), ("abcdeabcde", False), ("ccc", True), ("eabcd", True)]
    a = T.Automaton(entries)
    for _ in range(3000):
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12)))
        if rnd.random() < 0.6:
            t = list(rnd.choice(entries)[0])
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice("abcde")
            w = "".join(t) + ("ab" if rnd.random() < 0.2 else "")
        want = []
        for k, (term, stem) in enumerate(entries):
            d = min(distance(w[:n], term) for n in range(len(w) + 1)) if stem else distance(w, term)
            if d <= T.edits_for(len(term)):
                want.append((d, k))
        assert a.match(w) == min(want, default=None), w


def test_misspellings_are_caught_and_held_out_rows_score_well():
    model = T.fit(*zip(*[(t, y) for _, t, y in labelled(600, 1)]))
    right = [(model.score(t) >= T.THRESHOLD) == bool(y) for _, t, y in labelled(300, 2)]
    assert np.mean(right) > 0.98
    assert model.score("birds sing vilainous songs") > 0.5 > model.score("birds sing songs")
    assert model.score("") < 0.5 and model.score(None) == model.score("")


def test_quotation_counts_less_than_abuse():
    plain = [(f"you are a {b} and the river runs", 1) for b in BAD for _ in range(40)]
    quoted = [(f"witness said \"{b}\" while birds sing number {i}", 0) for b in BAD for i in range(12)]
    clean = [(t, 0) for _, t, y in labelled(400, 3) if not y]
    rows = [(f"{t} {i}", y) for i, (t, y) in enumerate(plain)] + quoted + clean
    model = T.fit(*zip(*rows))
    assert model.score("you are a rotter indeed") > model.score('witness said "rotter" while birds sing')


def test_toxicity_tables(spark, table):
    rows = labelled(400, 4)
    docs, labels = table([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    got = T.score(table([*[(i, t) for i, t, _ in rows], (None, None), (9, "")]), model)
    assert got.count() == len(rows) + 2 and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert got.filter(F.col("held_out") != F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))).count() == 0
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got.filter("predicted = 0").collect() if r["doc_id"] in {i for i, _, _ in rows}} & {i for i, _, _ in rows}
    assert T.score(docs, T.train(docs, labels.filter("toxic = 2"))).agg(F.max("score")).first()[0] == 0.0
    assert T.score(table([]), model).count() == 0


def test_learned_labels_are_only_those_not_held_out(spark, table):
    rows = labelled(400, 5)
    docs = table([(i, t) for i, t, _ in rows])
    flipped = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = (T.score(docs, T.train(docs, x)).orderBy("doc_id").toPandas()["score"] for x in (plain, flipped))
    assert (a - b).abs().max() < 0.5 and ((a >= 0.7) == (b >= 0.7)).mean() > 0.99


def brute_marginals(e, lengths, step):
    out, at, move = [], 0, np.exp(step)
    for n in lengths:
        x = e[at : at + n]
        at += n
        a, b = np.zeros_like(x), np.ones_like(x)
        for t in range(n):
            a[t] = (a[t - 1] @ move if t else 1) * x[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = move @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        out.append(a * b / (a * b).sum(1, keepdims=True))
    return np.concatenate(out)


@pytest.mark.parametrize("segment", [3, 16, 400])
def test_forward_backward_by_segments_is_exact(segment):
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 120, 9)
    e, step = rng.random((lengths.sum(), 4)) ** 3 + 1e-3, rng.normal(size=(4, 4))
    assert np.allclose(L.marginals(e, lengths, step, segment), brute_marginals(e, lengths, step), atol=1e-7)


def spoken(n, seed):
    rnd = random.Random(seed)
    parts = {"aa": ["ka", "mo", "ti", "lu"], "bb": ["schr", "eng", "ung", "ach"], "cc": ["zione", "etto", "issi", "gli"]}
    return [(i, " ".join("".join(rnd.choice(p) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 40))), lang) for i in range(n) for lang, p in [list(parts.items())[i % 3]]]


def test_languages_and_code_switches(spark, table):
    rows = spoken(240, 1)
    docs = spark.createDataFrame([(i, t, l, 1.0) for i, t, l in rows] + [(None, None, "aa", 1.0), (900, "123 ...", None, 1.0), (901, "", "bb", 1.0)], "doc_id long, text string, lang string, score double")
    field = L.train(docs)
    assert field.labels == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in L.identify(docs, field).collect()}
    assert np.mean([got[i]["lang_pred"] == l for i, _, l in rows]) > 0.98
    assert got[None]["lang_pred"] == got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0.0
    mixed = L.word_labels(field, "kamoti lukamo mokati tilumo schrung engach achung schrengung")
    assert [l for _, l, _ in mixed] == ["aa"] * 4 + ["bb"] * 4
    assert L.identify(docs, L.train(docs.filter("lang IS NULL"))).filter("lang_pred <> 'und'").count() == 0
    assert L.identify(table([]), field).count() == 0
