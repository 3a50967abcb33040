"""Removal of repeated substrings by bucket-pointer refinement.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same document.

1. Buckets. The start of every ``LENGTH``-byte window is sent to the bucket of
   one of its q-grams: the one of least hash, leftmost on ties, so equal
   windows always meet. Neighbouring windows share that gram and travel as one
   run ``(bucket, run hash, document, place)`` instead of byte by byte.
2. Whole runs. Of runs with equal bucket and run hash all but the earliest are
   repeats; a bucket left with one run is finished. Bucket and run are hashes
   of two independent families: 64 bits of the shared gram and 64 bits of the
   whole run (of 168 bytes at most). This is the only place where hashes decide.
3. Refinement. Buckets that hold several different runs fetch their bytes. Each
   start gets the identifier of its 8-byte bucket; sorting on the identifiers
   at offsets 8, 16, 32 and 36 further on refines the buckets to depth 16, 32,
   64 and ``LENGTH``, every step reusing the identifiers the last one updated
   and sorting only starts whose bucket still has company. This is exact.
4. A bucket of more than ``HOT`` runs would not fit in a task. Its windows are
   dealt to sub-buckets by hash over the cluster; those that have company there
   fetch their bytes, and equal bytes decide, as in 3.

Defined results: a null text counts as empty; texts shorter than ``LENGTH``
are kept whole; a null id sorts before every other; rows that repeat an id and
its text are the same document (they do not make each other repeats); rows of
one id with different texts are documents in the order of their texts' SHA-256;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import bounded_batches, by_bytes, documents, materialize, pick, release_shuffles, small_side

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 18
#: Runs of a bucket that one task refines (some 15 kB of memory each).
HOT = 4000
#: Bytes of runs that are refined together.
REFINE_BYTES = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NO_ID = -(1 << 63)

RUNS = "bucket long, run long, doc long, pos long"
#: A removed range when bucket is null, else a run that needs its bytes.
FOUND = "bucket long, doc long, start long, stop long, anchor int"


class Hashing:
    """Substring hashes of a byte chunk: differences of weighted prefix sums, mixed."""

    def __init__(self, size: int, family: int):
        table = np.random.default_rng(20240229 + family).integers(0, 1 << 64, 256, dtype=np.uint64)
        inverse = pow(_BASES[family], -1, 1 << 64)
        with np.errstate(over="ignore"):
            ones = np.full(size, _BASES[family], np.uint64)
            ones[0] = 1
            self.power = np.multiply.accumulate(ones)
            ones[1:] = inverse
            self.unpower = np.multiply.accumulate(ones)
        self.table = table

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mixed((prefix[width:] - prefix[:n]) * self.unpower[:n])

    def ranges(self, prefix: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((prefix[stop] - prefix[at]) * self.unpower[at] + (stop - at).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_HASHING: list[Hashing] = []


def hashing(family: int = 0) -> Hashing:
    """One of two independent families: other weights of bytes and another base."""
    if not _HASHING:
        _HASHING.extend(Hashing(CHUNK + 2 * LENGTH, k) for k in range(len(_BASES)))
    return _HASHING[family]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chunks(batch: pa.RecordBatch):
    """(data, doc, first place of each piece, ends) of about CHUNK bytes; long texts in pieces
    that overlap so that each window lies in exactly one."""
    texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    got, size = [], 0
    for i in range(len(texts)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for at in range(lo, max(hi - LENGTH + 1, lo), CHUNK):
            stop = min(hi, at + CHUNK + LENGTH - 1)
            if size and size + stop - at > CHUNK + LENGTH - 1:
                yield _joined(data, got)
                got, size = [], 0
            got.append((ids[i], at - lo, at, stop))
            size += stop - at
    if got:
        yield _joined(data, got)


def _joined(data, got):
    part = np.concatenate([data[a:b] for _, _, a, b in got])
    ends = np.cumsum([b - a for _, _, a, b in got])
    return part, np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64), ends


def runs_of(data: np.ndarray, ends: np.ndarray):
    """Runs of a chunk: bucket, run hash, piece, first window, windows, anchor's place in the run."""
    hs = hashing()
    prefix = hs.prefix(data)
    grams = hs.grams(prefix, GRAM)
    # 40 bits of hash, then the place: the least is the leftmost of least hash
    least = sliding_min((grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64), SPAN)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    piece = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
    place = np.arange(len(anchor))
    whole = place + LENGTH <= ends[piece]
    first = np.empty(len(anchor), bool)
    first[:1] = True
    first[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | ~whole[:-1]
    first &= whole
    at = np.flatnonzero(first)
    n = np.diff(np.append(np.cumsum(whole)[at] - 1, whole.sum()))
    a = anchor[at]
    other = hashing(1)
    run = other.ranges(other.prefix(data), at, at + n - 1 + LENGTH) + (a - at).astype(np.uint64)
    return grams[a].view(np.int64), mixed(run).view(np.int64), piece[at], at - starts[piece[at]], n, a - at


def packed_pos(at, left, n):
    return (at << 14) | (left << 7) | n


def _emit_runs(batches):
    """Runs of each chunk, the earliest of equal ones; the others at once as repeats (bit 62 of pos)."""
    for batch in batches:
        for data, ids, places, ends in chunks(batch):
            if len(data) < LENGTH:
                continue
            bucket, run, piece, at, n, left = runs_of(data, ends)
            doc, at = ids[piece], at + places[piece]
            pos = packed_pos(at, left, n)
            order = np.lexsort((pos, doc, run, bucket))
            bucket, run, doc, pos = bucket[order], run[order], doc[order], pos[order]
            same = np.zeros(len(order), bool)
            same[1:] = (bucket[1:] == bucket[:-1]) & (run[1:] == run[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            repeat = same & ((doc != doc[head]) | (pos != pos[head]))
            pos = np.where(repeat, pos | (1 << 62), pos)
            bucket = np.where(repeat, doc, bucket)  # any key: repeats only pass through
            keep = ~same | repeat
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, run, doc, pos)], names=["bucket", "run", "doc", "pos"])


def _found(bucket, doc, start, stop, anchor):
    return pa.RecordBatch.from_arrays(
        [bucket, pa.array(doc), pa.array(start), pa.array(stop), pa.array(anchor.astype(np.int32))], names=["bucket", "doc", "start", "stop", "anchor"]
    )


def _settle_runs(batches):
    """Over runs sorted by bucket, run, doc, pos: repeats of a whole run, and runs whose bucket has others."""
    carry = None  # bucket, run, doc, pos of the last earliest run; whether its bucket had another before it
    for batch in batches:
        bucket, run, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        through = (pos >> 62) == 1
        ready = [(None, doc[through], pos[through] & ~(1 << 62))]
        bucket, run, doc, pos = (x[~through] for x in (bucket, run, doc, pos))
        if carry is not None:
            bucket, run, doc, pos = (np.concatenate([[c], x]).astype(np.int64) for c, x in zip(carry, (bucket, run, doc, pos)))
        if len(bucket):
            fresh = np.ones(len(bucket), bool)
            fresh[1:] = (bucket[1:] != bucket[:-1]) | (run[1:] != run[:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(bucket)), 0))
            repeat = ~fresh & ((doc != doc[head]) | (pos != pos[head]))
            ready.append((None, doc[repeat], pos[repeat]))
            heads = np.flatnonzero(fresh)
            hb = bucket[heads]
            before = np.zeros(len(heads), bool)
            before[1:] = hb[1:] == hb[:-1]
            if carry is not None:
                before[0] = carry[4]
            after = np.zeros(len(heads), bool)
            after[:-1] = before[1:]
            sure = heads[(before | after)[: len(heads)] & (np.arange(len(heads)) < len(heads) - 1)]
            ready.append((bucket[sure], doc[sure], pos[sure]))
            last = heads[-1]
            carry = (bucket[last], run[last], doc[last], pos[last], bool(before[-1]))
        yield from _as_found(ready)
    if carry is not None and carry[4]:
        yield from _as_found([(np.array([carry[0]], np.int64), np.array([carry[2]], np.int64), np.array([carry[3]], np.int64))])


def _as_found(ready):
    for bucket, doc, pos in ready:
        if len(doc):
            at, left, n = pos >> 14, (pos >> 7) & 127, pos & 127
            yield _found(pa.nulls(len(doc), pa.int64()) if bucket is None else pa.array(bucket), doc, at, at + n - 1 + LENGTH, left)


def refine(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole windows of concatenated runs (their places) and the bucket of each at full depth."""
    starts = np.concatenate([[0], ends[:-1]])
    room = np.repeat(ends, ends - starts) - np.arange(len(data))  # bytes to the run's end
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    value = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    bucket = np.full(len(data), -1, np.int64)
    active = np.flatnonzero(room >= 8)
    _, inverse = np.unique(value[active], return_inverse=True)
    bucket[active] = inverse
    depth = 8
    for offset in (8, 16, 32, LENGTH - 64):
        new_depth = depth + offset
        size = int(bucket.max()) + 1
        member = np.bincount(bucket[active], minlength=size)
        active = active[(member[bucket[active]] > 1) & (room[active] >= new_depth)]
        pair = bucket[active] * size + bucket[active + offset]
        _, inverse = np.unique(pair, return_inverse=True)
        updated = bucket.copy()
        updated[active] = inverse + size  # identifiers of buckets with one start stay as they are
        bucket, depth = updated, new_depth
    return active, bucket[active]


def repeats_among(data, ends, doc, at):
    """(doc, start, stop) of ranges covered by windows that start earlier in another of these runs."""
    place, bucket = refine(data, ends)
    starts = np.concatenate([[0], ends[:-1]])
    slot = np.searchsorted(ends, place, side="right")
    d, p = doc[slot], at[slot] + place - starts[slot]
    order = np.lexsort((p, d, bucket))
    b, d2, p2 = bucket[order], d[order], p[order]
    head = np.maximum.accumulate(np.where(np.r_[True, b[1:] != b[:-1]][: len(b)], np.arange(len(b)), 0))
    later = np.sort(order[(d2 != d2[head]) | (p2 != p2[head])])
    return _joined_windows(d[later], p[later], slot[later])


def _joined_windows(d, p, slot):
    if not len(d):
        return d, p, p
    new = np.r_[True, (slot[1:] != slot[:-1]) | (p[1:] != p[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return d[first], p[first], p[last] + LENGTH


def _refine_sorted(batches):
    """Over runs sorted by bucket, with their bytes: whole buckets together, about REFINE_BYTES at a time."""

    def flush(held):
        data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        ends = np.cumsum([len(h[3]) for h in held])
        d, a, b = repeats_among(data, ends, np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "start", "stop"])

    held, size = [], 0
    for batch in (part for whole in batches for part in by_bytes(whole, 3, REFINE_BYTES)):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= REFINE_BYTES and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _slices(batches):
    """The bytes of each wanted run of a text."""
    for batch in (part for whole in batches for part in by_bytes(whole, 0, 1 << 20)):
        out = []
        for text, doc, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(w["bucket"], doc, w["start"], text[w["start"] : w["stop"]], w["hot"]) for w in wanted]
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "doc", "start", "bytes", "hot"])


def _windows(batches):
    """Single windows of hot runs: hash, doc, place, run's place; per batch the earliest of equal ones."""
    hs = hashing()
    for batch in (part for whole in batches for part in by_bytes(whole, 2, 1 << 17)):
        rows = []
        for doc, start, data in zip(*(c.to_pylist() for c in batch.columns)):
            prefix = hs.prefix(np.frombuffer(data, np.uint8))
            n = len(data) - LENGTH + 1
            at = np.arange(n)
            rows.append((hs.ranges(prefix, at, at + LENGTH).view(np.int64), np.full(n, doc, np.int64), start + at, np.full(n, start, np.int64)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["a", "doc", "start", "run_start"])


def _apply(batches):
    """Removed ranges taken out of each text."""
    for batch in (part for whole in batches for part in by_bytes(whole, 1, 1 << 20)):
        out = []
        for doc, text, starts, stops in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or b""
            removed = spans = at = 0
            digest = hashlib.sha256()
            stop = -1
            for a, b in sorted(zip(starts or (), stops or ())):
                a, b = min(a, len(text)), min(b, len(text))
                if a > stop or not spans:
                    digest.update(text[at:a])
                    spans += 1
                    removed += b - a
                    stop = b
                elif b > stop:
                    removed += b - stop
                    stop = b
                at = stop
            digest.update(text[at:])
            out.append((doc, len(text), removed, spans, digest.hexdigest()))
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, text, first: doc orders documents as their ids and tells apart different texts of one id; one row of a doc is its first."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    if not rows.groupBy(key.alias("doc")).count().filter("count > 1").limit(1).count():
        return rows.select("doc_id", key.alias("doc"), "text", F.lit(True).alias("first"))
    of = F.sha2(F.coalesce("text", F.lit(b"")), 256)
    keyed = materialize(rows.select("doc_id", key.alias("id"), of.alias("of"), F.monotonically_increasing_id().alias("row"), "text"), "suffix-rows")
    order = keyed.groupBy("id", "of").agg(F.min("row").alias("lead")).orderBy("id", "of").withColumn("doc", F.monotonically_increasing_id())
    return keyed.join(materialize(order, "suffix-order"), ["id", "of"]).select("doc_id", "doc", "text", (F.col("row") == F.col("lead")).alias("first"))


def repeated_ranges(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, start, stop (bytes) of ranges to remove, of rows (doc, text), no doc twice; they may overlap."""
    spark = rows.sparkSession
    bounded_batches(spark)
    runs = rows.select("doc", "text").mapInArrow(_emit_runs, RUNS)
    settled = runs.repartition("bucket").sortWithinPartitions("bucket", "run", "doc", "pos").mapInArrow(_settle_runs, FOUND)
    found = materialize(settled, "suffix-found")
    release_shuffles(spark)
    ranges = found.filter("bucket IS NULL").select("doc", "start", "stop")
    open_runs = found.filter("bucket IS NOT NULL")
    crowded = open_runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    crowded = materialize(crowded.select("bucket", F.lit(True).alias("hot")), "suffix-hot")
    some_hot = crowded.limit(1).count() > 0
    flagged = open_runs.join(small_side(crowded), "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if some_hot else open_runs.withColumn("hot", F.lit(False))
    wanted = flagged.groupBy("doc").agg(F.collect_list(F.struct("bucket", "start", "stop", "hot")).alias("wanted"))
    with_text = rows.join(wanted, "doc").select("text", "doc", "wanted")
    slices = with_text.mapInArrow(_slices, "bucket long, doc long, start long, bytes binary, hot boolean")
    if some_hot:
        slices = materialize(slices, "suffix-bytes")
    cold = slices.filter("NOT hot").drop("hot").repartition("bucket").sortWithinPartitions("bucket")
    ranges = ranges.unionByName(cold.mapInArrow(_refine_sorted, "doc long, start long, stop long"))
    if some_hot:
        held = slices.filter("hot").select("doc", "start", "bytes")
        single = materialize(held.mapInArrow(_windows, "a long, doc long, start long, run_start long"), "suffix-windows")
        company = single.groupBy("a").agg(F.min(F.struct("doc", "start")).alias("lo"), F.max(F.struct("doc", "start")).alias("hi")).filter("lo <> hi").select("a")
        company = single.join(small_side(materialize(company, "suffix-company"), 1_000_000), "a").select("doc", "start", "run_start")
        runs_of_doc = held.select("doc", F.col("start").alias("run_start"), "bytes")
        same = company.join(runs_of_doc, ["doc", "run_start"]).select("doc", "start", F.expr(f"substring(bytes, cast(start - run_start + 1 as int), {LENGTH})").alias("window"))
        same = materialize(same, "suffix-same")
        earliest = same.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("e"))
        later = same.join(earliest, "window").filter((F.col("doc") != F.col("e.doc")) | (F.col("start") != F.col("e.start")))
        ranges = ranges.unionByName(later.select("doc", "start", (F.col("start") + LENGTH).alias("stop")))
    return ranges


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _numbered(docs)
    ranges = materialize(repeated_ranges(rows.filter("first").select("doc", "text"), hot), "suffix-ranges")
    release_shuffles(docs.sparkSession)
    by_doc = ranges.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = rows.join(by_doc, "doc", "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


ORACLE = None
