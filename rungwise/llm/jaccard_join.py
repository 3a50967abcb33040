"""Exact n-gram Jaccard join in the metric space of shingle sets.

The distance of two documents is ``1 - |A & B| / |A | B|``; documents within
``r = 1 - threshold`` link, and links make components.

1. Cells, a filter. Unrelated texts all lie at distance 1 from each other, so
   no pivot parts a whole corpus; cells part it into groups that may hold
   links. Two linked documents differ in at most ``H`` shingles, a bound set by
   the smaller one's size. Shingles are dealt by hash to ``H + 1 + E`` parts,
   so at least ``E + 1`` parts are equal. A cell is the content of one part
   that holds two shingles or more. Documents with more than ``E`` smaller
   parts also go to the cells of their first shingles in hash order, as many
   as any linked set must meet. Documents near a size class boundary go to
   both classes.
2. First pivots. Each cell's first document is a pivot. Every document goes to
   the pivot that it shares most cells with and measures its exact distance;
   within ``r`` it links. A cell whose members are one component by now is done.
3. Regions. Of the cells that are not, a document needs only the rarest ones:
   of its k, two sets that share s or more meet in the first k - s + 1. Cells
   that share a document make one region. As a corpus grows, such chains join
   most of its documents, so a region larger than ``REGION_BYTES`` is parted
   first: two members of a cell stay together if the bitmaps of their sets
   differ in no more bits than linked sets do in shingles (no link is lost by
   that), or by a chain of such pairs. Inside a region pivots are chosen,
   every member measures its distance to all of them and is at home in the
   Voronoi region of the nearest. If x is at home with p, y with q and
   ``d(x, y) <= r``, then ``d(x, q) <= d(x, p) + 2 r``: a document in that window
   of an earlier pivot is replicated there, so every link is found in some
   region. Regions are joined in the same way again, over the cluster while
   they are larger than ``REGION_BYTES`` of text and inside one task from there
   on, down to ``LEAF`` members, each of which is a pivot to the others.
   Regions that pivots do not make smaller are cut into blocks of bounded
   bytes, and each two blocks are joined the same way.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer than
``shingle`` words counts as one shingle. Sets are compared for equality by 128
bits of two independent hashes; a link between different sets is accepted on
the words of the shingles themselves.

The result has components, not counts of links: a group of near copies may
hold a third of all rows, and its links are as many as the square of that.

Defined results: null, empty or blank texts have no shingles and link with
nothing; equal sets link; rows that repeat an id are one document, which links
wherever one of its texts does; a null id is an id of its own, the smallest;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import bisect
import math
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import bounded_batches, by_bytes, documents, materialize, pick, release_shuffles, small_side
from rungwise.llm.components import components

#: Text that one task joins at a time.
REGION_BYTES = 1 << 22
#: Pivots of a region; members down to which a region is parted.
PIVOTS = 8
LEAF = 32
#: A region whose parts keep more of its text than that is cut into blocks.
SHRINKS = 0.8
#: Cells of more members are joined apart from the others, by broadcast of the cell's name.
HEAVY = 1000
#: Bytes of words that a worker remembers.
WORDS_HELD = 1 << 26
#: Bits of a set's bitmap at most; members of a cell whose bitmaps one task compares.
BITS = 1 << 12
MEETING = 20_000
#: Share of the texts' bytes that is shuffled at one time to be joined; a round has so many bytes at least.
ROUND, ROUND_BYTES = 0.5, 1 << 28
_NO_ID = -(1 << 63)

#: What the shuffle of cells carries: ``set`` (size and digest) is null but for one row a document.
SHIPPED = "cell long, doc long, set binary"
SHINGLED = "kind int, cell long, doc long, n long, h1 long, h2 long, need long"


# ---------------------------------------------------------------- shingle sets

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(8).integers(0, 1 << 63, (64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HALF = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text; split() without an argument parts at exactly the six bytes named above."""
    return text.translate(_LOWER).split()


class Vocabulary(dict):
    """Places of words, with two 64-bit hashes of each."""

    def __init__(self):
        self.hashes = np.empty((1 << 12, 2), np.uint64)
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        h = xxhash.xxh3_128_intdigest(word)
        self.hashes[i, 0], self.hashes[i, 1] = h >> 64, h & _HALF
        self.held += len(word) + 100
        return i


def shingle_sets(texts: list[bytes], k: int, words: Vocabulary | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles as two aligned arrays of hashes, ascending."""
    words = Vocabulary() if words is None else words
    split = [words_of(t) for t in texts]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64)
    hashes = words.hashes[flat]
    joined = np.zeros((max(len(flat) - k + 1, 0), 2), np.uint64)
    for j in range(k if len(joined) else 0):
        joined += hashes[j : len(flat) - k + 1 + j] * _ODD[j]
    joined = _mixed(joined)
    out, at = [], 0
    for part in split:
        count = len(part)
        if count >= k:
            a, b = joined[at : at + count - k + 1].T
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            same = a[1:] == a[:-1]
            if (same & (b[1:] != b[:-1])).any():  # two shingles of one first hash
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            new = np.r_[True, ~same]
            out.append((a[new], b[new]))
        elif count:
            few = _mixed((hashes[at : at + count] * _ODD[:count]).sum(0, dtype=np.uint64) + np.uint64(count))
            out.append((few[:1], few[1:]))
        else:
            out.append((joined[:0, 0], joined[:0, 1]))
        at += count
    return out


class _Places(dict):
    def __missing__(self, key) -> int:
        i = self[key] = len(self)
        return i


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending numbers, equal in these texts if and only if their words are."""
    split = [words_of(t) for t in texts]
    flat = np.fromiter(map(_Places().__getitem__, chain.from_iterable(split)), np.int64)
    several = int(flat.max(initial=0)) + 1
    ids = flat
    for j in range(1, k):  # runs of j + 1 words, numbered anew so that numbers stay below the count of words
        ids = ids[:-1] * several + flat[j:] if len(flat) > j else flat[:0]
        ids = np.unique(ids, return_inverse=True)[1]
    short, out, at = _Places(), [], 0
    for part in split:
        if len(part) >= k:
            out.append(np.unique(ids[at : at + len(part) - k + 1]))
        else:
            out.append(np.array([len(flat) + short[tuple(part)]] if part else [], np.int64))
        at += len(part)
    return out


# ---------------------------------------------------------------- cells


class Cells:
    """Size classes and the parts whose contents name a set's cells."""

    def __init__(self, num: int, den: int, largest: int = 1 << 26):
        self.num, self.den = num, den
        self.tops = [1]
        while self.tops[-1] < largest:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * den // num))

    def class_of(self, n: int) -> int:
        return bisect.bisect_left(self.tops, n)

    def differing(self, n: int) -> int:
        """Most shingles in which a set of n and a linked one of at least n differ."""
        return (self.den - self.num) * n // self.num

    @lru_cache(maxsize=4096)  # noqa: B019
    def parts(self, c: int) -> tuple[int, int]:
        """Parts of a class, and how many weak ones a set may have."""
        top = self.tops[c]
        h = self.differing(top)
        if not h:
            return 1, 0
        best = (2.0, 0)
        for spare in range(h + 2):
            m = h + 1 + spare
            mean = top * (1 + self.num / self.den) / 2 / m
            weak = math.exp(-mean) * (1 + mean) * m
            term = below = math.exp(-weak)
            for i in range(1, spare + 1):  # Poisson: at most spare weak parts
                term *= weak / i
                below += term
            best = min(best, (1 - below, spare))
            if best[0] < 1e-4:
                break
        return h + 1 + best[1], best[1]

    def of(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """Cells of a sorted set, as signed 64-bit keys, and how many of them it shares at least with any linked set."""
        n = len(s)
        if not n:
            return np.empty(0, np.int64), 0
        out, need, crowded = [], None, False
        for c in range(self.class_of(-(-n * self.num // self.den)), self.class_of(n) + 1):
            m, spare = self.parts(c)
            part = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
            count = np.bincount(part, minlength=m)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s), dtype=np.uint64)])
            stop = np.cumsum(count)
            content = total[stop] - total[stop - count]
            key = _mixed(content + np.uint64(c * 0x9E3779B97F4A7C15 % (1 << 64)) + np.arange(m, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            weak = count < 2
            if m > 1:
                key = key[~weak]
                crowded = crowded or weak.sum() > spare
            # of a linked pair's parts at most as many differ as it has differing shingles; small equal parts are no cells
            least = m - self.differing(min(self.tops[c], n)) - int(weak.sum() if m > 1 else 0)
            need = least if need is None else min(need, least)
            out.append(key)
        if crowded:
            out.append(_mixed(s[: n + (-n * self.num // self.den) + 1] ^ np.uint64(0xA0761D6478BD642F)))
        return np.concatenate(out).view(np.int64), max(need, 1)


def _digest(s: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s[0].tobytes() + s[1].tobytes())
    return (h >> 64) - (1 << 63), (h & _HALF) - (1 << 63)


def _shingled(k: int, num: int, den: int, passes: int, nth: int):
    """Each document with its set's size and digest (in the first pass); this pass's cells of each distinct set of a slice."""

    def run(batches):
        cells, words = Cells(num, den), Vocabulary()
        for batch in batches:
            for some in by_bytes(batch, 1, 1 << 19):
                ids = some.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                if words.held > WORDS_HELD:
                    words = Vocabulary()
                sets = shingle_sets([t or b"" for t in some.column(1).to_pylist()], k, words)
                digests = [_digest(s) for s in sets]
                named = [cells.of(s) for s, _ in sets]
                if nth == 0:
                    extra = [struct.pack("<qqqq", len(s), *h, need) for (s, _), h, (_, need) in zip(sets, digests, named)]
                    yield _shipped(np.array([h[0] for h in digests], np.int64), ids, pa.array(extra, pa.binary()))
                first: dict = {}
                for i in np.argsort(ids, kind="stable").tolist():
                    first.setdefault(digests[i], i)
                mine = [i for i in first.values() if len(sets[i][0])]
                keys = [named[i][0] for i in mine]
                if passes > 1:
                    keys = [x[(x.view(np.uint64) >> np.uint64(40)) % np.uint64(passes) == nth] for x in keys]
                if keys:
                    key = np.concatenate(keys)
                    doc = np.repeat(ids[mine], [len(x) for x in keys])
                    yield _shipped(key, doc, pa.nulls(len(key), pa.binary()))

    return run


def _shipped(cell, doc, extra):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cell)), pa.array(np.ascontiguousarray(doc)), extra], names=["cell", "doc", "set"])


def _batch(kind, cell, doc, n, h1, h2, need):
    names = ["kind", "cell", "doc", "n", "h1", "h2", "need"]
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in (cell, doc, n, h1, h2, need))], names=names)


def _shared_cells(batches):
    """Over rows sorted by cell and doc: documents; members of cells that have two, with the first as n."""
    held = None  # cell, first doc, whether the first was given out
    for batch in batches:
        cell, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        rows = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        if rows.any():
            sets = np.array([struct.unpack("<qqqq", x) for x in batch.column(2).drop_null().to_pylist()], np.int64)
            zero = np.zeros(len(sets), np.int64)
            yield _batch(zero, zero, doc[rows], *sets.T)
        cell, doc = cell[~rows], doc[~rows]
        if held is not None:
            cell, doc = np.r_[held[0], cell], np.r_[held[1], doc]
        if not len(cell):
            continue
        fresh = np.r_[True, cell[1:] != cell[:-1]]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(cell)), 0))
        shared = np.zeros(len(cell), bool)
        shared[~fresh] = True
        shared[head[~fresh]] = True
        if held is not None and held[2]:
            shared[0] = False  # given out already
        given = bool(shared[head[-1]]) or (held is not None and held[2] and head[-1] == 0)
        zero = np.zeros(int(shared.sum()), np.int64)
        if shared.any():
            yield _batch(zero + 1, cell[shared], doc[shared], doc[head][shared], zero, zero, zero)
        held = (cell[-1], doc[head[-1]], given)


# ---------------------------------------------------------------- exact distances


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int):
    return den * common >= num * (a + b - common)


def common_with(one: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many shingles of each set (concatenated, none empty) are in ``one``."""
    mark = np.zeros(int(max(flat.max(initial=0), one.max(initial=0))) + 1, np.uint8)
    mark[one] = 1
    return np.add.reduceat(mark[flat], starts, dtype=np.int64)


class Region:
    """Sets in memory, and the components that links found so far make of them."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, num: int, den: int, side: np.ndarray | None = None):
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.comp = np.unique(label, return_inverse=True)[1]
        self.side = np.full(len(sets), -1) if side is None else side
        self.reach = (den - num) / den
        self.links: list[tuple[int, int]] = []

    def measure(self, i: int, members: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distances of members to set i; those within reach are linked to it."""
        common = common_with(self.sets[i], flat, starts)
        near = linked(common, self.sizes[i], self.sizes[members], self.num, self.den)
        for j in members[near & (self.comp[members] != self.comp[i])].tolist():
            if self.comp[i] != self.comp[j]:
                self.comp[self.comp == self.comp[j]] = self.comp[i]
                self.links.append((i, j))
        return 1 - common / (self.sizes[i] + self.sizes[members] - common)

    def flat(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(self.sizes[members])
        return np.concatenate([self.sets[j] for j in members.tolist()]), ends - self.sizes[members]

    def done(self, members: np.ndarray) -> bool:
        side = self.side[members]
        return len(members) < 2 or (self.comp[members] == self.comp[members[0]]).all() or (side[0] >= 0 and (side == side[0]).all())

    def join(self, home: np.ndarray, outer: np.ndarray) -> None:
        """Links among home members, and between home and outer ones."""
        members = np.concatenate([home, outer])
        if not len(home) or self.done(members):
            return
        if len(members) <= LEAF:
            return self.each_a_pivot(home, members)
        flat, starts = self.flat(members)
        inside = np.arange(len(members)) < len(home)
        table = np.empty((len(members), PIVOTS))
        chosen = 0
        for k in range(PIVOTS):  # each the home member farthest from those before
            table[:, k] = self.measure(int(members[chosen]), members, flat, starts)
            chosen = int(table[: len(home), : k + 1].min(1).argmax())
        own, best = table.argmin(1), table.min(1)
        for q in range(PIVOTS):
            mine = inside & (own == q)
            if not mine.any():
                continue
            at = table[:, q]
            window = (at <= best + 2 * self.reach + 1e-9) & (at <= at[mine].max() + self.reach + 1e-9)
            window &= np.where(inside, own > q, True)
            part, others = members[mine], members[window]
            if len(part) + len(others) > SHRINKS * len(members):
                both = np.concatenate([part, others])
                if not self.done(both):
                    self.each_a_pivot(part, both)
            else:
                self.join(part, others)

    def each_a_pivot(self, home: np.ndarray, members: np.ndarray) -> None:
        """Every home member measured against the members after it that it may still join."""
        for k, i in enumerate(home.tolist()):
            rest = members[k + 1 :]
            open_ = self.comp[rest] != self.comp[i]
            if self.side[i] >= 0:
                open_ &= self.side[rest] != self.side[i]
            low, high = np.minimum(self.sizes[rest], self.sizes[i]), np.maximum(self.sizes[rest], self.sizes[i])
            rest = rest[open_ & (self.den * low >= self.num * high)]
            if len(rest):
                self.measure(i, rest, *self.flat(rest))


def join_in_memory(texts: list[bytes], home: np.ndarray, label: np.ndarray, side: np.ndarray, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect different labels (a spanning forest of them), exactly."""
    region = Region(exact_sets(texts, k), label, num, den, side)
    some = region.sizes > 0
    region.join(np.flatnonzero(home & some), np.flatnonzero(~home & some))
    return region.links


# ---------------------------------------------------------------- bitmaps


def bitmap(s: np.ndarray) -> bytes:
    """Which remainders a set's hashes leave: a power of two of bits, no fewer than shingles up to ``BITS``."""
    bits = min(max(64, 1 << (len(s) - 1).bit_length()), BITS)
    mark = np.zeros(bits, np.uint8)
    mark[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(mark, bitorder="little").tobytes()


def _bitmaps(k: int):
    """Rows (doc, text) to doc, size and bitmap of the set."""

    def run(batches):
        words = Vocabulary()
        for batch in (part for whole in batches for part in by_bytes(whole, 1, 1 << 19)):
            if words.held > WORDS_HELD:
                words = Vocabulary()
            sets = [s for s, _ in shingle_sets([t or b"" for t in batch.column(1).to_pylist()], k, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], names=["doc", "n", "bits"])

    return run


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(rows.reshape(len(rows), -1, words), axis=1)


def close_pairs(n: np.ndarray, label: np.ndarray, side: np.ndarray, bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different labels (and sides, where they have one) whose sizes and bitmaps allow a link.

    Linked sets of a and b shingles differ in (a + b)(den - num) / (den + num) at
    most, and two bitmaps in no more bits than their sets in shingles.
    """
    width = np.array([len(x) // 8 for x in bits])
    maps = {w: np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(width == w)), np.uint64).reshape(-1, w) for w in np.unique(width).tolist()}
    comp, out = np.arange(len(n)), []
    for w in maps:
        own = np.flatnonzero(width == w)
        for v in (v for v in maps if v >= w):
            others = np.flatnonzero(width == v)
            theirs = _folded(maps[v], w)
            for at, i in enumerate(own.tolist()):
                rest = np.arange(at + 1 if v == w else 0, len(others))
                j = others[rest]
                low, high = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
                some = (label[j] != label[i]) & (comp[j] != comp[i]) & (den * low >= num * high) & ((side[j] != side[i]) | (side[i] < 0))
                rest, j = rest[some], j[some]
                if not len(j):
                    continue
                differ = np.bitwise_count(theirs[rest] ^ maps[w][at]).sum(1, dtype=np.int64)
                for m in j[(den + num) * differ <= (den - num) * (n[j] + n[i])].tolist():
                    if comp[m] != comp[i]:
                        comp[comp == comp[m]] = comp[i]
                        out.append((i, m))
    return out


def _close_in_cells(num: int, den: int):
    """Over rows (cell, doc, label, side, n, bits) sorted by cell: pairs that hold together what may link."""

    def close(held):
        _, doc, label, side, n, bits = zip(*held)
        return [(doc[i], doc[j]) for i, j in close_pairs(np.array(n, np.int64), np.array(label, np.int64), np.array(side, np.int64), list(bits), num, den)]

    def run(batches):
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    out += close(held)
                    held = []
                held.append(row)
            if out:
                yield _pairs(out)
                out = []
        if held:
            yield _pairs(close(held))

    return run


# ---------------------------------------------------------------- regions in tasks

ROWS = ["region", "doc", "home", "label", "side", "text"]


def _join_regions(k: int, num: int, den: int):
    """Over rows sorted by region: the links of each."""

    def joined(held):
        _, doc, home, label, side, texts = zip(*held)
        found = join_in_memory([t or b"" for t in texts], np.array(home, bool), np.array(label, np.int64), np.array(side, np.int64), k, num, den)
        return [(doc[i], doc[j]) for i, j in found]

    def run(batches):
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    out += joined(held)
                    held = []
                held.append(row)
            if out:
                yield _pairs(out)
                out = []
        if held:
            yield _pairs(joined(held))

    return run


def _pairs(rows):
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _to_pivots(k: int, num: int, den: int):
    """Members of a region (some of it, about REGION_BYTES) and its pivots: home, windows and links."""
    reach = (den - num) / den

    def run(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("p_p")
        sets = exact_sets([bytes(t) for t in [*members["text"], *pivots["p_text"]]], k)
        own, around = sets[: len(members)], sets[len(members) :]
        if not len(members) or not len(pivots):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in MEASURED_NAMES})
        sizes = np.array([len(s) for s in own], np.int64)
        flat, starts = np.concatenate(own), np.cumsum(sizes) - sizes
        table, near = np.empty((len(own), len(around))), np.empty((len(own), len(around)), bool)
        for j, s in enumerate(around):
            common = common_with(s, flat, starts)
            table[:, j] = 1 - common / (sizes + len(s) - common)
            near[:, j] = linked(common, sizes, len(s), num, den)
        best, nearest = table.min(1), table.argmin(1)
        window = table <= best[:, None] + 2 * reach + 1e-9
        home = members["home"].to_numpy(bool)
        window &= ~home[:, None] | (np.arange(len(around))[None, :] < nearest[:, None])
        number, label, pivot = (pivots[c].to_numpy() for c in ("p_p", "p_label", "p_doc"))
        return pd.DataFrame(
            {
                "region": members["region"], "doc": members["doc"], "home": home, "label": members["label"], "bytes": members["bytes"], "parent": members["parent"],
                "own": number[nearest], "windows": [number[w].tolist() for w in window],
                "hits": [[(int(a), int(b)) for a, b in zip(pivot[w], label[w])] for w in near],
            }
        )

    return run


MEASURED = "region long, doc long, home boolean, label long, bytes long, parent long, own int, windows array<int>, hits array<struct<doc: long, label: long>>"
MEASURED_NAMES = ["region", "doc", "home", "label", "bytes", "parent", "own", "windows", "hits"]


# ---------------------------------------------------------------- the join


def _star_pairs(k: int, num: int, den: int):
    """Rows (b, a, text) sorted by b, the pivot's own first (a = b): each a's distance to b."""

    def run(batches):
        pivot, text_of = None, b""
        for batch in (part for whole in batches for part in by_bytes(whole, 2, 1 << 18)):
            b, a, texts = (c.to_pylist() for c in batch.columns)
            out = ([], [], [], [])
            at = 0
            while at < len(b):
                stop = bisect.bisect_right(b, b[at], at)
                if b[at] != pivot:
                    pivot, text_of = b[at], texts[at] or b""
                mine = [i for i in range(at, stop) if a[i] != pivot]
                if mine:
                    one, *others = exact_sets([text_of, *((texts[i] or b"") for i in mine)], k)
                    sizes = np.array([len(s) for s in others], np.int64)
                    common = common_with(one, np.concatenate(others), np.cumsum(sizes) - sizes)
                    out[0].extend(a[i] for i in mine)
                    out[1].extend([pivot] * len(mine))
                    out[2].extend(linked(common, sizes, len(one), num, den).tolist())
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "links"])

    return run


def _star_links(stars: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of stars (a to its pivot b) that link. The rays of a pivot of many are dealt to several tasks, each with the pivot's text."""
    rays = stars.join(texts.select(F.col("doc").alias("a"), "bytes"), "a")
    crowded = rays.groupBy("b").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > REGION_BYTES)
    crowded = crowded.select("b", F.ceil(F.col("bytes") / REGION_BYTES).cast("int").alias("parts"))
    crowded = small_side(materialize(crowded, "jaccard-crowded"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = stars.join(crowded, "b", "left").select("b", "a", F.pmod(F.xxhash64("a"), parts).cast("int").alias("salt"))
    pivots = stars.select("b").distinct().join(crowded, "b", "left")
    pivots = pivots.select("b", F.col("b").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    rows = dealt.unionByName(pivots).join(texts.select(F.col("doc").alias("a"), "text"), "a")
    # a pivot's own row comes first
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", (F.col("a") != F.col("b")), "a").select("b", "a", "text")
    return rows.mapInArrow(_star_pairs(k, num, den), "a long, b long, links boolean").filter("links").select("a", "b")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("doc"), F.col("root").alias("label"))
    return members.join(named, "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Rows joined to their groups by key; ``groups`` counts ``members``, and rows of a group of many never meet in one task."""
    heavy = small_side(materialize(groups.filter(F.col("members") > HEAVY), tag))
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(groups.filter(F.col("members") <= HEAVY), keys)
    return rest.unionByName(rows.join(heavy, keys).select(*rest.columns))


def _contested(members: DataFrame) -> DataFrame:
    """Members of cells that hold several labels, with the cell's size."""
    cells = members.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"))
    cells = materialize(cells.filter("lo < hi OR members > %d" % HEAVY), "jaccard-contested")
    return _with_groups(members, cells, ["cell"], "jaccard-heavy").filter("lo < hi").drop("lo", "hi")


def _needed(contested: DataFrame, named: DataFrame) -> DataFrame:
    """Each document's rarest contested cells, as many as exactness needs.

    A linked document of another label shares ``need`` of them or more, so one
    with fewer has no link left to find: a passage that many texts quote gives
    each of them a few cells, which is not enough.
    """
    needs = named.filter("doc = rep").groupBy("doc").agg(F.min("need").alias("need"))
    has = contested.groupBy("doc", "label").agg(F.sort_array(F.collect_list(F.struct("members", "cell"))).alias("cells")).join(needs, "doc")
    first = F.slice("cells", 1, F.size("cells") - F.col("need").cast("int") + 1)
    return has.filter(F.size("cells") >= F.col("need")).select(F.explode(first).alias("c"), "doc", "label").select("c.cell", "doc", "label")


def jaccard_components(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, passes: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; texts link at num/den or more.

    Cells are shuffled in ``passes`` rounds, each reading the texts again, so
    the disk that the shuffle needs at one time is that share of all cells.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    if not rows.groupBy(key.alias("doc")).count().filter("count > 1").limit(1).count():
        found = _components_of(rows.select(key.alias("doc"), "text"), shingle, num, den, passes)
    else:
        # every row a node of its own; nodes of one id belong together
        nodes = materialize(rows.select(key.alias("id"), F.monotonically_increasing_id().alias("doc"), "text"), "jaccard-rows")
        of = _components_of(nodes.select("doc", "text"), shingle, num, den, passes).join(nodes.select("doc", "id"), "doc")
        of = materialize(of, "jaccard-nodes")
        firsts = of.groupBy("id").agg(F.min("component").alias("b"))
        ties = of.join(firsts, "id").select(F.col("component").alias("a"), "b").filter("a <> b").distinct()
        of = of.join(components(ties).withColumnRenamed("node", "component"), "component", "left").withColumn("root", F.coalesce("root", "component"))
        least = of.groupBy("root").agg(F.min("id").alias("component"))
        found = of.drop("component", "doc").join(least, "root").withColumnRenamed("id", "doc")
    ids = [F.when(F.col(c) != _NO_ID, F.col(c)) for c in ("doc", "component")]
    return found.select(ids[0].alias("doc_id"), F.col("n").alias("n_shingles"), ids[1].alias("component_id"))


def _components_of(rows: DataFrame, shingle: int, num: int, den: int, passes: int) -> DataFrame:
    """doc, n, component of rows (doc, text), no doc twice."""
    spark = rows.sparkSession
    settled = None
    for nth in range(passes):
        shingled = rows.mapInArrow(_shingled(shingle, num, den, passes, nth), SHIPPED)
        part = shingled.repartition("cell").sortWithinPartitions("cell", "doc").mapInArrow(_shared_cells, SHINGLED)
        part = materialize(part, "jaccard-cells")
        settled = part if settled is None else settled.unionByName(part)
        release_shuffles(spark)

    every = settled.filter("kind = 0").select("doc", "n", "h1", "h2", "need")
    classes = every.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("members"))
    named = _with_groups(every, classes, ["h1", "h2"], "jaccard-classes")
    named = materialize(named.select("doc", "n", "need", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc")).alias("rep")), "jaccard-sets")
    rep_of = named.filter("doc <> rep").select("doc", "rep")
    members = settled.filter("kind = 1").select("cell", "doc", F.col("n").alias("first"))
    for column in ("doc", "first"):
        other = rep_of.select(F.col("doc").alias(column), F.col("rep").alias("r"))
        members = members.join(other, column, "left").withColumn(column, F.coalesce("r", column)).drop("r")
    members = materialize(members.distinct(), "jaccard-members")

    involved = members.select("doc").union(members.select("first")).distinct()
    texts = materialize(rows.join(involved, "doc").select("doc", "text", F.length("text").cast("long").alias("bytes")), "jaccard-texts")
    release_shuffles(spark)

    # each document's first pivot, by the cells they share; where that is far, the cells stay open
    shared = members.filter("doc <> first").groupBy("doc", "first").agg(F.count(F.lit(1)).alias("cells"))
    nearest = shared.groupBy("doc").agg(F.max_by("first", F.struct("cells", (-F.col("first")).alias("low"))).alias("first"))
    stars = materialize(nearest.select(F.greatest("doc", "first").alias("a"), F.least("doc", "first").alias("b")).distinct(), "jaccard-stars")
    links = materialize(_star_links(stars, texts, shingle, num, den), "jaccard-near")
    roots = materialize(components(links), "jaccard-roots")
    release_shuffles(spark)

    needed = materialize(_needed(_contested(_labelled(members.select("cell", "doc"), roots)), named), "jaccard-needed")
    needed = materialize(_contested(needed), "jaccard-open")
    if needed.limit(1).count():
        links = links.unionByName(_region_links(needed, texts, shingle, num, den))
        roots = components(links)
    release_shuffles(spark)
    return named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "n", F.coalesce("root", "rep").alias("component"))


def _region_links(needed: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between labels within the regions that shared cells make up."""
    spark = needed.sparkSession
    firsts = needed.groupBy("cell").agg(F.min("doc").alias("b"))
    edges = needed.join(firsts, "cell").select(F.col("doc").alias("a"), "b").filter("a <> b").distinct()
    region = components(edges).select(F.col("node").alias("doc"), F.col("root").alias("region"))
    state = needed.select("doc", "label").distinct().join(region, "doc").join(texts.select("doc", "bytes"), "doc")
    state = materialize(state.select("region", "doc", F.lit(True).alias("home"), "label", "bytes", F.lit(1 << 62).alias("parent")), "jaccard-regions")
    state = _parted(state, needed, texts, k, num, den)
    found: list[DataFrame] = []
    while True:
        sums = state.groupBy("region").agg(F.sum("bytes").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("parent").alias("parent"), F.max("home").alias("any_home"))
        sums = materialize(sums.filter("lo < hi AND any_home").select("region", "size", (F.col("size") > SHRINKS * F.col("parent")).alias("stuck")), "jaccard-sizes")
        small = state.join(sums.filter(F.col("size") <= REGION_BYTES), "region").withColumn("side", F.lit(-1))
        large = small_side(sums.filter(F.col("size") > REGION_BYTES))
        big = state.join(large, "region")
        blocks = _in_blocks(big.filter("stuck"))
        found.append(_joined(small.select(*ROWS[:-1], "bytes").unionByName(blocks), texts, k, num, den))
        big = big.filter("NOT stuck")
        if not big.limit(1).count():
            break
        measured = materialize(_measured(big, texts, k, num, den), "jaccard-measured")
        hits = measured.select(F.col("doc").alias("a"), "label", F.explode("hits").alias("h"))
        found.append(materialize(hits.select("a", F.col("h.doc").alias("b")), "jaccard-found"))
        merged = components(hits.select(F.col("label").alias("a"), F.col("h.label").alias("b")).filter("a <> b").distinct())
        merged = small_side(materialize(merged.withColumnRenamed("node", "label"), "jaccard-merged"))
        parts = F.array_union(F.transform("windows", lambda q: F.struct(q.alias("q"), F.lit(False).alias("home"))), F.when(F.col("home"), F.array(F.struct(F.col("own").alias("q"), F.lit(True).alias("home")))).otherwise(F.array()))
        state = measured.select("region", "doc", "label", "bytes", "parent", F.explode(parts).alias("p"))
        state = state.join(merged, "label", "left").select(
            F.xxhash64("region", "p.q").alias("region"), "doc", F.col("p.home").alias("home"), F.coalesce("root", "label").alias("label"), "bytes", "parent"
        )
        state = materialize(state, "jaccard-regions")
        release_shuffles(spark)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.filter("a <> b")


def _parted(state: DataFrame, needed: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Large regions as the components of their pairs that share a cell and may link by size and bitmap; the others as they are."""
    large = state.groupBy("region").agg(F.sum("bytes").alias("size")).filter(F.col("size") > REGION_BYTES).select("region")
    large = small_side(materialize(large, "jaccard-large"))
    if not large.limit(1).count():
        return state
    inside = materialize(state.join(large, "region"), "jaccard-inside")
    sets = materialize(texts.join(small_side(inside.select("doc")), "doc").select("doc", "text").mapInArrow(_bitmaps(k), "doc long, n long, bits binary"), "jaccard-bitmaps")
    # cells of the same members tell the same, so one of them is enough
    cells = needed.join(inside.select("doc"), "doc", "left_semi").groupBy("cell").agg(
        F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"), *[F.sum(F.shiftright(F.xxhash64(F.lit(i), "doc"), 24)).alias(f"h{i}") for i in range(4)]
    )
    cells = cells.filter("lo < hi").groupBy("members", *[f"h{i}" for i in range(4)]).agg(F.min("cell").alias("cell"))
    meeting = materialize(needed.join(cells.select("cell", F.ceil(F.col("members") / MEETING).cast("int").alias("blocks")), "cell"), "jaccard-meeting")
    met = _met(meeting, meeting["blocks"], "cell").select("cell", "doc", "label", "side")
    shipped = met.join(sets.select("doc", F.length("bits").alias("bytes")), "doc").agg(F.sum(F.col("bytes") + 40)).first()[0] or 0
    rounds = _rounds(shipped, texts)
    pairs = None
    for nth in range(rounds):
        mine = met.filter(F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(rounds)) == nth).join(sets, "doc").select("cell", "doc", "label", "side", "n", "bits")
        part = mine.repartition("cell").sortWithinPartitions("cell", "doc").mapInArrow(_close_in_cells(num, den), "a long, b long")
        part = materialize(part, "jaccard-close")
        pairs = part if pairs is None else pairs.unionByName(part)
        release_shuffles(state.sparkSession)
    parts = components(pairs).select(F.col("node").alias("doc"), F.xxhash64(F.lit(0), "root").alias("part"))
    inside = inside.join(parts, "doc").withColumn("region", F.col("part")).select(*state.columns)
    return materialize(state.join(large, "region", "left_anti").unionByName(inside), "jaccard-regions")


def _rounds(shipped: int, texts: DataFrame) -> int:
    """Rounds in which so many bytes are shuffled, each a bounded share of the texts."""
    held = texts.agg(F.sum("bytes")).first()[0] or 0
    return max(1, math.ceil(shipped / max(ROUND_BYTES, ROUND * held)))


def _joined(rows: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of regions; their texts, of which blocks make many copies, are shuffled in rounds."""
    rows = materialize(rows, "jaccard-rows")
    rounds = _rounds(rows.agg(F.sum("bytes")).first()[0] or 0, texts)
    out = None
    for nth in range(rounds):
        mine = rows.filter(F.pmod(F.xxhash64("region", F.lit(1)), F.lit(rounds)) == nth).join(texts.select("doc", "text"), "doc").select(*ROWS)
        part = mine.repartition("region").sortWithinPartitions("region", "doc").mapInArrow(_join_regions(k, num, den), "a long, b long")
        part = materialize(part, "jaccard-found")
        out = part if out is None else out.unionByName(part)
        if rounds > 1:
            release_shuffles(rows.sparkSession)
    return out


def _measured(big: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Members of large regions with their nearest pivot, windows and links; each task has about REGION_BYTES of one region."""
    parts = F.ceil(F.col("size") / REGION_BYTES).cast("int")
    chosen = big.filter("home").groupBy("region", parts.alias("parts")).agg(
        F.array_distinct(F.array(*[F.min_by(F.struct("doc", "label"), F.xxhash64("doc", F.lit(i))) for i in range(PIVOTS)])).alias("pivots")
    )
    pivots = chosen.select("region", "parts", F.posexplode("pivots").alias("p", "v")).select("region", "p", "v.doc", "v.label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    pivots = pivots.join(texts.select("doc", "text"), "doc")
    pivots = pivots.select(*[F.col(c).alias(f"p_{c}") for c in ("region", "salt", "p", "doc", "label", "text")])
    members = big.withColumn("salt", F.pmod(F.xxhash64("doc"), parts).cast("int")).withColumn("parent", F.col("size"))
    members = members.select("region", "salt", "doc", "home", "label", "bytes", "parent").join(texts.select("doc", "text"), "doc")
    return members.groupBy("region", "salt").cogroup(pivots.groupBy("p_region", "p_salt")).applyInPandas(_to_pivots(k, num, den), MEASURED)


def _in_blocks(stuck: DataFrame) -> DataFrame:
    """Regions that pivots leave whole, as pairs of blocks of bounded bytes."""
    return _met(stuck, F.ceil(F.col("size") * 2 / REGION_BYTES), "region").select(*ROWS[:-1], "bytes")


def _met(rows: DataFrame, blocks, group: str) -> DataFrame:
    """Rows of a group dealt to so many blocks: each two of them a group, whose rows are of side 0 or 1, and each one by itself (-1)."""
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(lo == hi, -1).when(F.col("block") == lo, 0).otherwise(1)
    return met.withColumns({group: F.xxhash64(group, lo, hi), "side": side})


def keep_one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, passes: int = 1) -> DataFrame:
    """The input's rows with one document of each component, the one of smallest id, all columns unchanged."""
    found = jaccard_components(docs, shingle, num, den, passes)
    staying = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("k_id")).distinct()
    return docs.join(staying, docs["doc_id"].eqNullSafe(staying["k_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE
lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM lowered),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.e = b.e AND a.doc_id < b.doc_id
          AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM reach r JOIN sides p ON p.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""
