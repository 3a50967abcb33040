import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rungwise.llm import packing as m


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(m.default_tokenizer_path())


def pieces(tokenizer, rows, capacity):
    out = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def valid(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity, per_partition", [(4096, 50_000), (64, 40)])
def test_pieces_and_layout(table, corpus, tokenizer, capacity, per_partition):
    rows = [*corpus, (5000, "it's <|endoftext|> 'LL a\xa0b ½3² 日本 \x1c"), (5001, "word " * 9000)]
    got = m.pack_documents(table(rows), capacity=capacity, per_partition=per_partition).collect()
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == pieces(tokenizer, rows, capacity)
    used = valid(got, capacity)
    bound = m.lower_bound(np.array([r["length"] for r in got]), capacity)
    assert bound <= used <= 1.05 * bound + 3


def test_nulls_repeats_and_empty_tables(table):
    got = m.pack_documents(table([(1, None), (1, None), (None, ""), (2, "a")])).collect()
    assert sorted(r["length"] for r in got) == [1, 1, 1, 2] and valid(got, 4096) == 1
    assert m.pack_documents(table([])).count() == 0


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_and_bound(lengths):
    x = np.array(lengths)
    bins, offsets, used = m.best_fit_decreasing(x, 100)
    fill = np.bincount(bins, weights=x)
    assert fill.max() <= 100 and len(fill) == used
    assert -(-x.sum() // 100) <= m.lower_bound(x, 100) <= used
    order = np.lexsort((offsets, bins))
    expected = np.concatenate([np.cumsum(x[order][bins[order] == b]) - x[order][bins[order] == b] for b in range(used)])
    assert (offsets[order] == expected).all()


def test_bound_sees_large_items():
    assert m.lower_bound(np.array([51] * 7), 100) == 7
    assert m.lower_bound(np.array([34] * 9), 100) == 5


def test_other_tokenizer_files_take_whole_texts(spark, table):
    """A file whose steps before the merges are not those that words are remembered by."""
    from pathlib import Path

    from tokenizers import Tokenizer

    path = str(Path(m.default_tokenizer_path()).with_name("byte_bpe_50k.json"))
    rows = [(1, "Some Text, it's 42 words\n\tlong"), (2, None), (3, "Ünï  code " * 50)]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in m.token_pieces(table(rows), path, 64).collect()), key=str)
    assert got == pieces(Tokenizer.from_file(path), rows, 64)
    assert not m.memo_for(Path(path).read_text(encoding="utf-8")).by_word and m.memo_for(Path(m.default_tokenizer_path()).read_text(encoding="utf-8")).by_word
