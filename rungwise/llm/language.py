"""Language identification by a linear-chain conditional random field over words.

Every word gets a label. Its potentials come from hashed features: the word
itself (lexicon), its prefixes and suffixes, and its letter n-grams; labels of
neighbouring words are tied by learned transitions, so code-switched texts
come out as runs. Forward-backward gives each word's marginals; a document's
score per language is the mean over its words. Training maximises the
likelihood of word sequences, pieces of different documents joined so that
transitions between languages are seen.

Training samples at most about ``TRAIN_DOCS`` documents of each language by a
hash of the id, and of each whole text ``TRAIN_PIECES`` runs of ``PIECE`` words
by a hash of the run's words; the workers cut them out, so the driver never
gets a text. Words of more than ``WORD_LETTERS`` letters are not learned from.
Predictions read whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is everything if no document is labelled; of languages of equal score
the first in order of name is predicted; repeated rows come out alike;
a null id is carried and counts as held out from training; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import bounded_batches, by_bytes, documents, materialize, pick, small_side

#: Documents of each language that training samples, runs of words of each, words of a run, letters of a word.
TRAIN_DOCS = 500
TRAIN_PIECES = 6
PIECE = 20
WORD_LETTERS = 100
BUCKETS = 1 << 16
SEGMENT = 64
WORDS = re.compile(r"[^\W\d_]+")
NONE = "und"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, hashed feature) pairs: the word, its letter pairs and triples with both
    ends marked (so affixes of one and two letters too), and affixes of three letters."""
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words]) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    room = ends[owner] - np.arange(len(codes))
    b = np.uint64(1000003)
    two = codes[:-1] * b + codes[1:]
    three = two[:-1] * b + codes[2:]
    four = three[:-1] * b + codes[3:]
    long = sizes >= 5
    power = np.ones(int(sizes.max()), np.uint64)
    power[1:] = np.uint64(0x100000001B3)
    power = np.multiply.accumulate(power)
    whole = np.add.reduceat(codes * power[np.arange(len(codes)) - starts[owner]], starts)
    at2, at3 = np.flatnonzero(room >= 2), np.flatnonzero(room >= 3)
    owners = (owner[at2], owner[at3], np.flatnonzero(long), np.flatnonzero(long), np.arange(len(words)))
    hashes = (two[at2], three[at3], four[starts[long]], four[ends[long] - 4] + np.uint64(1), whole + np.uint64(2))
    return np.concatenate(owners), _mixed(np.concatenate([h * np.uint64(8) + np.uint64(k) for k, h in enumerate(hashes)]))


def _summed(emit: np.ndarray, owner: np.ndarray, feature: np.ndarray, count: int) -> np.ndarray:
    """Each word's weights by label, over the root of its number of features."""
    sums = np.stack([np.bincount(owner, weights=emit[feature, k], minlength=count) for k in range(emit.shape[1])], axis=1)
    return sums / np.sqrt(np.bincount(owner, minlength=count))[:, None]


class Field:
    """Weights of features by label, transitions, and the labels; small and picklable."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.emit = np.zeros((BUCKETS, len(labels)), np.float32)
        self.step = np.zeros((len(labels), len(labels)))
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def potentials(self, words: list[str]) -> np.ndarray:
        """exp of each word's summed weights, scaled to a maximum of 1."""
        known = self._known
        if len(known) > 200_000:
            known.clear()
        new = list(set(words) - known.keys())
        if new:
            sums = _summed(self.emit, *features(new), len(new))
            known.update(zip(new, np.exp(sums - sums.max(1, keepdims=True)).astype(np.float32)))
        return np.array([known[w] for w in words], dtype=np.float64)


def marginals(e: np.ndarray, lengths: np.ndarray, step: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Label marginals of concatenated sequences, by forward-backward.

    Sequences are cut into segments. The product of a segment's matrices
    carries messages across it, so all segments run at once and a long
    sequence costs as many steps as it has segments, without approximation.
    """
    k = e.shape[1]
    move = np.exp(step)
    pieces = -(-lengths // segment)
    total = int(pieces.sum())
    if not total:
        return np.empty((0, k))
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(total) - first[owner]
    start = (np.cumsum(lengths) - lengths)[owner] + nth * segment
    size = np.minimum(segment, lengths[owner] - nth * segment)
    at = start[:, None] + np.minimum(np.arange(segment), size[:, None] - 1)
    local = e[at]  # segments, places, labels
    there = np.arange(segment)[None, :] < size[:, None]
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(segment):
        go = np.flatnonzero(there[:, t])
        if not len(go):
            break
        after = (product[go] @ move) * local[go, t][:, None, :]
        product[go] = after / after.sum((1, 2), keepdims=True)
    # messages into each segment: forward from its first, backward from its last
    into, out_of = np.ones((total, k)), np.ones((total, k))
    # a sequence's first word has no transition: a message that the transition turns into ones
    opening = np.linalg.lstsq(move.T, np.ones(k), rcond=None)[0]
    into[nth == 0] = opening
    for j in range(1, int(pieces.max())):
        here = np.flatnonzero(nth == j)
        before = here - 1
        message = np.einsum("ni,nij->nj", into[before], product[before])
        into[here] = message / message.sum(1, keepdims=True)
    last = nth == pieces[owner] - 1
    for j in range(int(pieces.max()) - 1, 0, -1):
        here = np.flatnonzero(nth == j)
        message = np.einsum("nij,nj->ni", product[here], np.where(last[here][:, None], 1.0, out_of[here]))
        out_of[here - 1] = message / message.sum(1, keepdims=True)
    out_of[last] = 1.0
    forward = np.empty_like(local)
    now = into
    for t in range(segment):
        arriving = now @ move
        if t == 0:
            arriving[nth == 0] = 1.0
        now = np.where(there[:, t][:, None], arriving * local[:, t], now)
        now = now / now.sum(1, keepdims=True)
        forward[:, t] = now
    backward = np.empty_like(local)
    now = out_of
    for t in range(segment - 1, -1, -1):
        backward[:, t] = now
        sent = (local[:, t] * now) @ move.T
        now = np.where(there[:, t][:, None], sent / sent.sum(1, keepdims=True), now)
    both = forward * backward
    both /= both.sum(2, keepdims=True)
    return both[there]


def sampled_pieces(text: str, most: int = TRAIN_PIECES) -> list[list[str]]:
    """Runs of words of a text, those of least hash."""
    words = [w for w in WORDS.findall(text.lower()) if len(w) <= WORD_LETTERS]
    runs = [words[at : at + PIECE] for at in range(0, len(words), PIECE)]
    keyed = sorted((zlib.crc32(" ".join(r).encode("utf-8", "surrogatepass")), k) for k, r in enumerate(runs))[:most]
    return [runs[k] for _, k in sorted(keyed, key=lambda x: x[1])]


def train_field(samples: list[tuple[list[list[str]], str]], epochs: int = 6, rate: float = 0.5, seed: int = 3) -> Field | None:
    """Learn a field by Adagrad on pieces of documents joined into sequences."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    field = Field(labels)
    rng = np.random.default_rng(seed)
    pieces = [(words, labels.index(lang)) for runs, lang in samples for words in runs]
    emit = np.zeros((BUCKETS, len(labels)))
    squares, step_squares = np.full(emit.shape, 1e-8), np.full(field.step.shape, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for at in range(0, len(order), 256):
            some = [pieces[i] for i in order[at : at + 256]]
            words = [w for p, _ in some for w in p]
            gold = np.array([y for p, y in some for _ in p])
            if not words:
                continue
            distinct, place = np.unique(words, return_inverse=True)
            owner, feature = features(distinct.tolist())
            norm = 1 / np.sqrt(np.bincount(owner))
            # four pieces to a sequence, so labels change inside
            sizes = np.array([sum(len(p) for p, _ in some[i : i + 4]) for i in range(0, len(some), 4)])
            sizes = sizes[sizes > 0]
            z = _summed(emit, owner, feature, len(distinct))[place]
            e = np.exp(z - z.max(1, keepdims=True))
            got = marginals(e, sizes, field.step)
            error = got
            error[np.arange(len(gold)), gold] -= 1
            by_word = np.stack([np.bincount(place, weights=error[:, k]) for k in range(len(labels))], axis=1) * norm[:, None]
            gradient = np.stack([np.bincount(feature, weights=by_word[owner, k], minlength=BUCKETS) for k in range(len(labels))], axis=1)
            squares += gradient**2
            emit -= rate * gradient / np.sqrt(squares + 1.0)
            # transitions: observed pairs against pairs expected from neighbouring marginals
            inner = np.ones(len(gold) - 1, bool)
            inner[np.cumsum(sizes)[:-1] - 1] = False
            seen = np.zeros_like(field.step)
            np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
            whole = got.copy()
            whole[np.arange(len(gold)), gold] += 1
            pair = whole[:-1][inner][:, :, None] * np.exp(field.step) * e[1:][inner][:, None, :]
            expected = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            g = (expected - seen) / 50
            step_squares += g**2
            field.step -= 0.1 * g / np.sqrt(step_squares + 1.0)
    field.emit = emit.astype(np.float32)
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Field | None:
    """A field from about ``most`` documents of each language, those of least hash among the ones not held out."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # of each language the share that leaves about ``most``; a few more, never many fewer
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(most + 4 * most**0.5) / F.count(F.lit(1))).alias("share"))
    chosen = rows.join(small_side(materialize(shares, "lang-shares"), 10_000), "lang").filter(place < F.col("share"))

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, 2, 1 << 20):
                runs = [sampled_pieces(t) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.list_(pa.string())))], names=["doc_id", "lang", "runs"])

    samples = chosen.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, runs array<array<string>>")
    one = samples.groupBy("doc_id").agg(F.min(F.struct("lang", "runs")).alias("s"))  # of rows that repeat an id one
    got = sorted(one.collect(), key=lambda r: r["doc_id"])  # ``most`` documents a language, TRAIN_PIECES * PIECE words each
    return train_field([(r["s"]["runs"], r["s"]["lang"]) for r in got])


def _words(text: str) -> list[str]:
    """Words of a text that holds a letter (the pattern alone would take other numerals for letters)."""
    words = WORDS.findall(text.lower())
    return words if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w) else []


def predictions(field: Field | None, texts: list[str | None]) -> list[tuple[str, float]]:
    split = [_words(t) if t else [] for t in texts]
    if field is None:
        return [(NONE, 0.0)] * len(texts)
    words = [w for x in split for w in x]
    lengths = np.array([len(x) for x in split])
    if not words:
        return [(NONE, 0.0)] * len(texts)
    full = lengths > 0
    got = marginals(field.potentials(words), lengths[full], field.step)
    sums = np.zeros((len(texts), len(field.labels)))
    sums[full] = np.add.reduceat(got, (np.cumsum(lengths) - lengths)[full], axis=0) / lengths[full][:, None]
    best = sums.argmax(1)
    return [(field.labels[b], float(min(1.0, s[b]))) if f else (NONE, 0.0) for b, s, f in zip(best, sums, full)]


def word_labels(field: Field, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its label and marginal."""
    words = WORDS.findall(text.lower())
    if not words:
        return []
    got = marginals(field.potentials(words), np.array([len(words)]), field.step)
    return [(w, field.labels[m.argmax()], float(m.max())) for w, m in zip(words, got)]


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, 1, 1 << 20):
                got = predictions(field, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))


ORACLE = None
