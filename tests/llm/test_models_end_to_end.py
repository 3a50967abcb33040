"""The two models' queries against plain forms that share none of their machinery."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from test_models import BAD, brute_marginals, distance, labelled, spoken

from rungwise.llm import language as L
from rungwise.llm import toxicity as T


def plain_match(model, word):
    """(edits, entry) by edit distances to every entry."""
    found = []
    for k, (term, stem) in enumerate(model.entries):
        d = min(distance(word[:n], term) for n in range(len(word) + 1)) if stem else distance(word, term)
        if d <= T.edits_for(len(term)):
            found.append((d, k))
    return min(found, default=None)


def plain_quoted(text):
    """Whether each word stands between two marks of one paragraph."""
    out = []
    for paragraph in re.split(r"\n[ \t]*\n", text):
        parts = re.split("[\"«»“”„‹›]", paragraph)
        for i, part in enumerate(parts):
            out += [i % 2 == 1 and i < len(parts) - 1] * len(re.findall(r"[^\W_]+", part))
    return out


def plain_score(model, text, seen):
    text = text or ""
    words = re.findall(r"[^\W_]+", text.lower())
    quoted = plain_quoted(text)
    f = np.zeros(7)
    plain, total, n = [], 0.0, 0
    for i, w in enumerate(words):
        if w not in seen:
            seen[w] = plain_match(model, w)
        if seen[w] is None:
            continue
        edits, entry = seen[w]
        near = words[max(0, i - 5) : i] + words[i + 1 : i + 6]
        weight = model.weight[entry, edits > 0] + max(-3.0, min(3.0, sum(model.context.get(x, 0.0) for x in near)))
        n += 1
        if quoted[i]:
            f[5] += 1
        else:
            plain.append(weight)
            total += max(weight, 0.0)
        f[2 + (edits > 0)] += 1
    if n:
        f[0], f[1], f[2], f[3], f[4], f[5], f[6] = max(plain, default=0.0), math.log1p(total), math.log1p(f[2]), math.log1p(f[3]), n / len(words), f[5] / n, 1.0
    z = sum((f - model.mean) / model.scale * model.beta) + model.bias
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_scores_of_a_table_follow_the_plain_form(spark, table):
    rows = labelled(300, 9)
    rnd = random.Random(1)
    extra = [(1000 + i, f'they wrote "{rnd.choice(BAD)} and birds" about the river, not {rnd.choice(BAD)[:-1]}x\n\n"open {rnd.choice(BAD)} mark') for i in range(10)]
    texts = [(i, t) for i, t, _ in rows] + extra + [(2000, None), (2001, ""), (2002, "..."), (2003, "scoundrel " * 5 + "river " * 2000), (1000, extra[0][1]), (None, extra[1][1])]
    model = T.train(table([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    seen = {}
    got = T.score(table(texts), model).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in got) == sorted((i or -1, round(plain_score(model, t, seen), 9)) for i, t in texts)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_training_in_the_workers_is_training_in_memory(spark, table):
    rows = labelled(600, 10)
    docs, labels = table([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    used = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    one = T.train(docs, labels)
    n = sum(y for _, y in used)
    other = T.fit([t for t, _ in used], [y for _, y in used], odds=n / (len(used) - n))
    assert one.entries == other.entries and one.weight == other.weight and one.context == other.context
    assert np.allclose(one.beta, other.beta) and one.bias == pytest.approx(other.bias)


def test_lexicon_and_texts_have_no_bound():
    """A term that only stands far inside very long texts is learned, and thousands of terms are kept."""
    far = "calm " * 60_000
    texts = [far + f"vilething end{i}" for i in range(5)] + [f"calm day number {i}" for i in range(60)]
    model = T.fit(texts, [1] * 5 + [0] * 60)
    assert ("vilething", False) in model.entries or any("vilething".startswith(t) for t, stem in model.entries if stem)
    counts = [(False, f"{i:04d}word", 0, 3, []) for i in range(4000)]
    assert len(T.lexicon(counts, {0: 4000, 1: 60})) == 4000


def plain_prediction(field, text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    e = np.concatenate([field.potentials([w]) for w in words])
    mean = brute_marginals(e, [len(words)], field.step).mean(0)
    return field.labels[int(mean.argmax())], float(mean.max())


def test_predictions_of_a_table_follow_the_plain_form(spark, table):
    rows = spoken(90, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = L.train(docs)
    joined = " ".join(t for _, t, _ in rows)
    texts = [(i, t) for i, t, _ in rows] + [(500, joined), (501, joined * 20), (502, None), (503, "12 34"), (504, ""), (3, rows[3][1]), (None, "kamo schreng")]
    got = sorted(((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6)) for r in L.identify(table(texts), field).collect()), key=str)
    assert got == sorted(((i or -1, p, round(s, 6)) for i, t in texts for p, s in [plain_prediction(field, t)]), key=str)


def test_each_language_is_sampled_and_from_all_of_a_text(spark):
    """One document in 400 is of a rare language, and its words come after thousands of digits."""
    common = [(i, "kamo lutika molu tika", "aa") for i in range(4000)]
    rare = [(10_000 + i, "7 " * 5000 + "schreng achung engung schrach", "bb") for i in range(10)]
    field = L.train(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"), most=50)
    assert field.labels == ["aa", "bb"]
    assert [p for p, _ in L.predictions(field, ["schreng engung", "lutika molu"])] == ["bb", "aa"]
    assert L.sampled_pieces(" ".join(f"w{'x' * (i % 7)}y" for i in range(2000))) != [["wy"] * 20] * 6
