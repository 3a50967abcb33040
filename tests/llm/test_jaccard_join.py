import random
import re

import numpy as np
import pytest

from rungwise.llm import jaccard_join as m
from rungwise.llm.components import components


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x.group().lower(), t or ""))


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k, num, den, region, leaf, heavy", [(4, 85, 100, 1 << 22, 32, 1000), (5, 80, 100, 2000, 3, 2)])
def test_against_brute_force(table, corpus, monkeypatch, k, num, den, region, leaf, heavy):
    for name, value in (("REGION_BYTES", region), ("LEAF", leaf), ("HEAVY", heavy)):
        monkeypatch.setattr(m, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(table(corpus), k, num, den).collect()}
    assert got == brute(corpus, k, num, den)


def families(seed, count, members):
    """Texts around bases, so that links lie inside families and chain past the pivots' reach."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(count):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(30, 90))]
        for _ in range(rnd.randint(1, members)):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                t[rnd.randrange(len(t))] = f"v{rnd.randrange(500)}"
            rows.append(" ".join(t))
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("leaf", [2, 8, 64])
def test_regions_in_memory_find_every_link(monkeypatch, leaf):
    monkeypatch.setattr(m, "LEAF", leaf)
    rnd = random.Random(leaf)
    for seed in range(8):
        texts = [t for _, t in families(seed, 12, 20)]
        n = len(texts)
        home = np.array([rnd.random() < 0.7 for _ in range(n)])
        side = np.full(n, -1) if seed % 2 else np.array([rnd.randrange(2) for _ in range(n)])
        got = m.join_in_memory([t.encode() for t in texts], home, np.arange(n), side, 4, 85, 100)
        sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(words, texts)]
        link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
        assert all(link(i, j) for i, j in got)
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in got:
            root[find(i)] = find(j)
        assert all(find(i) == find(j) for i in range(n) for j in range(i) if (home[i] or home[j]) and (side[i] < 0 or side[i] != side[j]) and link(i, j))


@pytest.mark.parametrize("region", [3000])
def test_large_regions_part_by_pivots_and_blocks(table, monkeypatch, region):
    monkeypatch.setattr(m, "REGION_BYTES", region)
    monkeypatch.setattr(m, "LEAF", 4)
    rows = families(5, 10, 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(table(rows)).collect()}
    assert got == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("meeting, least", [(20_000, 1 << 28), (5, 3000)])
def test_chains_of_shared_passages_are_no_region(table, monkeypatch, meeting, least):
    """Texts of three passages each: nearly all in one chain of cells, few linked. Regions cut into blocks would make many copies of each."""
    rnd = random.Random(3)
    pool = [[f"p{i}w{j}" for j in range(8)] for i in range(40)]
    rows = [(i, " ".join(w for p in rnd.sample(pool, 3) for w in p) + f" z{i}") for i in range(400)]
    rows += [(400 + i, t + " more") for i, (_, t) in enumerate(rows[::10])]
    for name, value in (("REGION_BYTES", 4000), ("MEETING", meeting), ("ROUND_BYTES", least), ("ROUND", 0.01)):
        monkeypatch.setattr(m, name, value)
    counts, joined = [], m._joined
    monkeypatch.setattr(m, "_joined", lambda rows, *a: counts.append(rows.count()) or joined(rows, *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(table(rows), 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100)
    assert sum(counts) <= len(rows)


def test_bitmaps_part_no_linked_sets():
    rng = np.random.default_rng(5)
    for num, den in ((80, 100), (85, 100), (1, 2)):
        for n in (1, 3, 40, 64, 129, 1000, 5000):
            sets, size = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))], (den - num) * n // den
            for lost in (0, size // 2, size):  # of n shingles: num / den of them kept, or as many added
                sets += [sets[0][lost:], np.sort(np.r_[sets[0], rng.integers(0, 1 << 63, lost * den // num if num else lost, dtype=np.uint64)])]
            sets = [s for s in sets if len(s) and den * len(np.intersect1d(s, sets[0])) >= num * len(np.union1d(s, sets[0]))]
            for i in range(1, len(sets)):
                two = [sets[0], sets[i]]
                assert len(m.close_pairs(np.array([len(s) for s in two]), np.arange(2), np.full(2, -1), [m.bitmap(s) for s in two], num, den)) == 1
                assert len(m.close_pairs(np.array([len(s) for s in two]), np.arange(2), np.array([0, 1]), [m.bitmap(s) for s in two], num, den)) == 1
                assert not m.close_pairs(np.array([len(s) for s in two]), np.arange(2), np.array([1, 1]), [m.bitmap(s) for s in two], num, den)
    far = [np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(50)]
    assert not m.close_pairs(np.full(50, 300), np.arange(50), np.full(50, -1), [m.bitmap(s) for s in far], 80, 100)


def test_words_that_polynomial_hashes_confuse(table):
    even = [bin(i).count("1") % 2 for i in range(1024)]
    word, other = "".join("ab"[e] for e in even), "".join("ba"[e] for e in even)
    got = {r["doc_id"]: r["component_id"] for r in m.jaccard_components(table([(1, word), (2, other), (3, f"{word} {other} x y z"), (4, f"{other} {word} x y z")])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_that_repeat_an_id_link_by_each_of_their_texts(table):
    a, b, c = ("one two three four five six", "red green blue grey pink gold", "north south east west up down")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in m.jaccard_components(table([(1, a), (5, a), (5, b), (7, b.upper()), (8, c), (8, c), (9, "")])).collect())
    assert got == [(1, 3, 1), (5, 3, 1), (5, 3, 1), (7, 3, 1), (8, 3, 8), (8, 3, 8), (9, 0, 9)]


def test_very_long_texts(table):
    rnd = random.Random(2)
    long = [f"w{rnd.randrange(40000)}" for _ in range(60000)]
    near = [w if i % 400 else "changed" for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:40000])), (4, "x" * 300000), (5, "x" * 300000 + "y")]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(table(rows)).collect()} == brute(rows, 4, 85, 100)


def test_linked_sets_always_share_the_cells_they_need():
    rng = np.random.default_rng(5)
    cells = m.Cells(85, 100)
    for n in (1, 4, 6, 7, 13, 40, 130, 600):
        for _ in range(25):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            drop = rng.integers(0, max(1, int(0.15 * len(base)) + 1))
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.int64).astype(np.uint64)]))
            common = len(np.intersect1d(base, other))
            if len(other) and m.linked(common, len(base), len(other), 85, 100):
                (a, need_a), (b, need_b) = cells.of(base), cells.of(other)
                assert len(np.intersect1d(a, b)) >= max(need_a, need_b) >= 1


def test_nulls_repeats_and_empty_tables(table):
    got = [tuple(r) for r in m.jaccard_components(table([(5, None), (6, " \t"), (7, "a b"), (8, "A B"), (8, "A B"), (None, "a b"), (9, "b a")])).collect()]
    assert sorted(got, key=str) == sorted([(5, 0, 5), (6, 0, 6), (7, 1, None), (8, 1, None), (8, 1, None), (None, 1, None), (9, 1, 9)], key=str)
    assert m.jaccard_components(table([])).count() == 0


def test_keep_one_of_each_keeps_columns(table):
    df = table([(4, "one two three four five six"), (2, "ONE two three four five six"), (3, "else"), (9, None)])
    got = m.keep_one_of_each(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3, 9]


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 51), (51, 52), (52, 50)] + [(60, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 30)}, 50: 50, 51: 50, 52: 50}
