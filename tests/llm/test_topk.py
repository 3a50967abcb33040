import math

import numpy as np
import pytest

from rungwise.llm import topk as m


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))
            out += [(qi, n + 1, ci, -s) for n, (s, ci) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("block", [4096, 37])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (450, [0.5, 0.25]), (451, [1.0, 2.0])]
    got = sorted(tuple(r) for r in m.top_k(frame(spark, rows), k=5, every=50).collect())
    assert got == brute(rows, 5, 50)


def test_repeated_query_ids_are_one_query(spark):
    rows = [(0, [2.0, 1.0]), (0, [2.0, 1.0]), (0, [-9.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 3.0]), (7, [5.0, 1.0])]
    got = sorted(tuple(r) for r in m.top_k(frame(spark, rows)).collect())
    assert got == brute([rows[2], *rows[3:]], 5, 50) and [r[1] for r in got] == [1, 2, 3, 4]


def test_blocks_out_of_reach_are_never_read(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 64)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) + (40 if i % 50 == 0 or i % 7 == 0 else -40)).tolist()) for i in range(1, 1500)]
    found, evaluated = m.search(frame(spark, rows), k=3, every=50)
    queries = sum(1 for i, _ in rows if i % 50 == 0)
    assert evaluated.agg({"evaluated": "sum"}).first()[0] < 0.2 * queries * len(rows)
    assert sorted(tuple(r) for r in m.top_k(frame(spark, rows), k=3, every=50).collect()) == brute(rows, 3, 50)


def test_few_candidates_large_values_and_empty_tables(spark):
    rows = [(0, [3.0e4, -2.0]), (1, [3.0e4, 5.0]), (50, [-1.0, 0.0])]
    assert sorted(tuple(r) for r in m.top_k(frame(spark, rows)).collect()) == brute(rows, 5, 50)
    assert m.top_k(frame(spark, [])).count() == 0


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(7)
    c = np.concatenate([rng.integers(-9, 9, (3000, 6)), rng.integers(800, 900, (40, 6))])
    q = c[-5:]
    pivots = c[:: len(c) // 16]
    ids = np.arange(len(c))
    got, evaluated = m.best_of_blocks(ids[-5:], q, m.pivot_table(q, pivots), ids, c, m.pivot_table(c, pivots), 5, chunk=32)
    want = []
    for i, x in zip(ids[-5:], q):
        s = c @ x
        want += [(int(i), int(j), int(s[j])) for j in sorted(set(ids) - {i}, key=lambda j: (-s[j], j))[:5]]
    assert sorted(got) == sorted(want) and evaluated < 5 * len(c) / 4
