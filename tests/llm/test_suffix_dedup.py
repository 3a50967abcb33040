import hashlib

import numpy as np
import pytest

from rungwise.llm import suffix_dedup as m


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted((i, (t or "").encode()) for i, t in rows):
        mask = np.zeros(len(text), bool)
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                mask[p : p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(text, np.uint8)[~mask])
        out[i] = (len(text), int(mask.sum()), int((np.diff(np.r_[0, mask]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def got(df, **how):
    return {r["doc_id"]: tuple(r)[1:] for r in m.remove_repeats(df, **how).collect()}


@pytest.mark.parametrize("hot", [m.HOT, 3])
def test_against_brute_force(table, corpus, hot):
    assert got(table(corpus), hot=hot) == brute(corpus)


def test_long_texts_over_several_chunks(table):
    part = " ".join(f"{i * i}" for i in range(9000))
    rows = [(1, part + " one " + part[:5000]), (2, part[100:900] + "z" * (m.CHUNK + 500)), (3, "q" + "z" * 300)]
    assert len(rows[1][1]) > m.CHUNK
    assert got(table(rows)) == brute(rows)


def test_repeats_nulls_and_empty_tables(table):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    rows = [tuple(r)[1:4] for r in m.remove_repeats(table([(1, text), (1, text), (None, None), (None, text)])).orderBy("doc_id").collect()]
    assert sorted(rows) == sorted([(0, 0, 0), (len(text), 0, 0), (len(text), len(text), 1), (len(text), len(text), 1)])
    assert m.remove_repeats(table([])).count() == 0


def test_rows_of_one_id_with_different_texts(table):
    part = "".join(f"{i}," for i in range(60))
    a, b = "x" + part, "yy" + part + "z"
    first, second = sorted([a, b], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in m.remove_repeats(table([(4, a), (4, b), (4, b), (9, "short")])).collect()}
    assert rows == {(4, len(first)): 0, (4, len(second)): len(part), (9, 5): 0}


def test_hash_families_are_independent():
    """Two windows whose inner bytes agree under one family differ under the other."""
    one, other = m.hashing(0), m.hashing(1)
    data = np.arange(200).astype(np.uint8)
    at = np.arange(100)
    x, y = (h.ranges(h.prefix(data), at, at + 100) for h in (one, other))
    assert len(set(x)) == len(set(y)) == 100 and not set(x) & set(y)
    assert one.table is not other.table and (one.table != other.table).all() and one.power[1] != other.power[1]


def test_refined_buckets_are_exact():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[1500:2200] = data[100:800]
    place, bucket = m.refine(data, np.array([1400, 3000]))
    windows = {}
    for p, b in zip(place.tolist(), bucket.tolist()):
        assert windows.setdefault(b, bytes(data[p : p + 100])) == bytes(data[p : p + 100])
    assert len(set(windows.values())) == len(windows)
