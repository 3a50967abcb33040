"""Best-fit packing of token sequences with bound-certified repacking.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Pieces are dealt by hash to partitions of about ``per_partition`` rows, each
partition runs best-fit decreasing, and dual feasible functions give a lower
bound on the bins that its pieces need. A partition whose bin count equals its
bound is certified. The others keep their completely full bins, exchange the
rest of their documents under a new hash and run again; a round counts only if
it lowers the number of bins of the partitions that took part.

Defined results: a null text counts as empty; an empty text is one piece
holding the closing id only; repeated rows are packed as often as they occur;
a null id is carried along; an empty table gives an empty result; other
columns of the input are never read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import bounded_batches, by_bytes, documents, materialize, pick, release_shuffles

CAPACITY = 4096
CLOSING_ID = 1
PER_PARTITION = 50_000
ROUNDS = 3
#: Words a worker remembers; a full memory is only slower.
REMEMBERED_WORDS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, bin long, offset long, round int"
CERTIFICATES = "round int, part long, bins long, bound long"

# ---------------------------------------------------------------- tokens

#: Latin text without the characters that white-space rules or composition treat specially.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
#: Steps before the merges that words may be split and remembered by (fixed values); other files take whole texts.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: That split pattern, for such text after lower-casing.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")


def _splits_words(plan: dict) -> bool:
    """Whether a tokenizer file normalises and splits as ``_WORDS`` does, and marks the end of words."""
    before = (plan.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return bool(
        (plan.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and [x.get("type") for x in before] == ["Split", "ByteLevel"]
        and before[0].get("pattern") == {"Regex": _SPLIT}
        and before[0].get("invert")
        and not before[1].get("add_prefix_space")
        and plan["model"].get("end_of_word_suffix")
        and not plan.get("post_processor")
    )


class WordMemo:
    """Token ids of whole texts, remembering the ids of each word (little-endian bytes).

    Words are split as the tokenizer's own pattern splits them and never merge
    with each other, so a text's ids are those of its words in order. Texts
    beyond plain Latin characters go through the tokenizer whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # words are normalised and split already: the same merges without those steps
        plan = json.loads(tokenizer_json)
        self.by_word = _splits_words(plan)
        self.known: dict[str, bytes] = {}
        if not self.by_word:
            return
        byte_level = [x for x in plan["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel"]
        plan |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *byte_level]}}
        self.word_tokenizer = Tokenizer.from_str(json.dumps(plan))
        suffix = plan["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def learn(self, words: list[str]) -> None:
        """Ids of words, many to a call, told apart by the tokens that end a word."""
        some = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for part, got in zip(some, self.word_tokenizer.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False)):
            ids = np.asarray(got.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(stops) == len(part):
                data = ids.tobytes()
                self.known.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                self.known.update((w, self.whole(w)) for w in part)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def ids_of(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        known = self.known
        split = [_WORDS.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        new = set().union(*(w for w in split if w)) - known.keys()
        if new:
            if len(known) > REMEMBERED_WORDS:
                known.clear()
                new = set().union(*(w for w in split if w))
            self.learn(list(new))
        return [self.whole(t) if w is None else b"".join(map(known.__getitem__, w)) for t, w in zip(texts, split)]


_MEMOS: dict[str, WordMemo] = {}


def memo_for(tokenizer_json: str) -> WordMemo:
    """One memory per worker process, kept from task to task."""
    if tokenizer_json not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[tokenizer_json] = WordMemo(tokenizer_json)
    return _MEMOS[tokenizer_json]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of little-endian 32-bit ids."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Each document's pieces, from its whole text."""
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")  # of fixed size, sent with the task
    closing = np.asarray([closing_id], dtype="<u4").tobytes()

    def run(batches):
        memo = memo_for(tokenizer_json)
        for batch in batches:
            for some in by_bytes(batch, 1, 1 << 20):
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), memo.ids_of([t or "" for t in some.column(1).to_pylist()])):
                    rows += [(doc_id, *x) for x in cut(ids + closing, capacity)]
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    bounded_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- packing


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins = [0] * len(sizes)
    offsets = [0] * len(sizes)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some bin has room r
    used = 0
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not with_room[left]:
                rooms |= 1 << left
            with_room[left].append(b)
    return np.asarray(bins, dtype=np.int64), np.asarray(offsets, dtype=np.int64), used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    # f_a(x): 1 above capacity - a, x itself from a to capacity - a, 0 below a
    n_to, sum_to = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    large = n_to[-1] - n_to[capacity - a]
    middle = sum_to[capacity - a] - np.where(a > 0, sum_to[np.maximum(a - 1, 0)], 0)
    best = max(best, int((large + -(-middle // capacity)).max()))
    # u_k(x): floor((k+1)x)/k, or x itself where (k+1)x is whole
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


def _pack(pieces: DataFrame, part_count: int, round_no: int, capacity: int) -> DataFrame:
    """Deal pieces to partitions and run best-fit decreasing in each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, _ = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=bins, offset=offsets, round=np.int32(round_no))[
            ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "round"]
        ]

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_no)), F.lit(part_count)))
    return dealt.groupBy("part").applyInPandas(run, PACKED)


def _certificates(packed: DataFrame, capacity: int) -> DataFrame:
    """Per partition: bins used and the lower bound, from counts by length (at most ``capacity`` rows each)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = np.repeat(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame(
            {"round": pdf["round"].iloc[:1], "part": pdf["part"].iloc[:1], "bins": [int(pdf["bins"].iloc[0])], "bound": [lower_bound(lengths, capacity)]}
        )

    used = packed.groupBy("round", "part").agg((F.max("bin") + 1).alias("bins"))
    by_length = packed.groupBy("round", "part", "length").agg(F.count(F.lit(1)).alias("n"))
    return by_length.join(used, ["round", "part"]).groupBy("round", "part").applyInPandas(run, CERTIFICATES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with sequence_id and offset; sequences hold at most ``capacity`` tokens."""
    pieces = materialize(pieces, "pack-pieces")
    n = pieces.count()
    packed = materialize(_pack(pieces, max(1, -(-n // per_partition)), 0, capacity), "pack-0")
    done: list[DataFrame] = []  # bins that stay, by round
    for k in range(1, rounds + 1):
        certs = materialize(_certificates(packed, capacity), "pack-bounds")
        open_parts, open_bins = certs.filter("bins > bound").agg(F.count(F.lit(1)), F.coalesce(F.sum("bins"), F.lit(0))).first()
        if open_parts < 2:  # nothing to exchange with
            break
        fill = packed.groupBy("part", "bin").agg((F.sum("length") == capacity).alias("full"))
        marked = packed.join(fill, ["part", "bin"]).join(certs.select("part", "bins", "bound"), "part")
        marked = marked.withColumn("stays", F.col("full") | (F.col("bins") <= F.col("bound")))
        marked = materialize(marked, f"pack-marked-{k}")
        going = marked.filter("NOT stays").drop("part", "bin", "offset", "round")
        before = marked.filter("NOT stays").select("part", "bin").distinct().count()
        again = materialize(_pack(going.select(*pieces.columns), max(1, -(-going.count() // per_partition)), k, capacity), f"pack-{k}")
        after = again.select("part", "bin").distinct().count()
        if after >= before:
            break
        done.append(marked.filter("stays").select(*packed.columns))
        packed = again
    whole = packed
    for one in done:
        whole = whole.unionByName(one)
    # round, partition and bin name a sequence: 8, 27 and 28 bits
    sequence = F.shiftleft(F.col("round").cast("long"), 55) + F.shiftleft(F.col("part"), 28) + F.col("bin")
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, **how) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path or default_tokenizer_path(), capacity), capacity, **how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(documents(spark, sf_dir))
    release_shuffles(spark)
    return out


ORACLE = None
