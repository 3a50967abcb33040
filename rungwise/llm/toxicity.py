"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon (terms, and stems that any ending may follow) and all weights are
learned from labelled documents. At scoring time one automaton, the union of
the Levenshtein automata of all entries walked along their common trie, reads
each distinct word; its states are made when first needed. A hit's weight is
the learned log-odds of its entry at its edit distance; words around the hit
and quotation marks add a learned context score that tells quoting from
abuse. A logistic model over a document's hits gives the score.

Training reads the whole texts of at most ``TRAIN_ROWS`` labelled rows of each
class, chosen by a hash of the id. It counts in the workers: the driver gets
counts of the terms that may enter the lexicon, of the words around hits, and
one short row of features per document, never a text.

Defined results: null and empty texts score as texts without hits; labels
that are null are no labels, of repeated ones the largest counts; without any
labels of both kinds every score is 0; repeated rows score alike; a null id
is carried and counts as not held out; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm._shared import bounded_batches, by_bytes, documents, materialize, pick

THRESHOLD = 0.7
#: Labelled rows of each class that training reads at most.
TRAIN_ROWS = 3000
WINDOW = 5
WORDS = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"«»“”„‹›]")


def edits_for(length: int) -> int:
    """Edit distance at which an entry of so many letters still matches."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Levenshtein automata of all entries, intersected with their trie and determinised on demand.

    A state is a set of (trie node, edits so far). ``match`` gives the entry
    of fewest edits, the first in the lexicon's order among equals.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[tuple[int, bool] | None] = [None]
        self.most: list[int] = [0]  # edits that some entry below the node allows
        for k, (term, stem) in enumerate(entries):
            node, allowed = 0, edits_for(len(term))
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            if self.entry[node] is None:
                self.entry[node] = (k, stem)
        self.allowed = [edits_for(len(t)) for t, _ in entries]
        self.start = self._closed({(0, 0)})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple] = {}

    def _closed(self, state: set) -> frozenset:
        """With letters of an entry left out, at one edit each; dominated pairs dropped."""
        best: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, edits = todo.pop()
            if edits > self.most[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _move(self, state: frozenset, c: str) -> frozenset:
        after = set()
        for node, edits in state:
            after.add((node, edits + 1))  # a letter too many
            for letter, child in self.children[node].items():
                after.add((child, edits + (letter != c)))
        return self._closed(after)

    def _end(self, state: frozenset) -> tuple:
        """(edits, entry) best at a word's end, and best of stems, which match anywhere from here on."""
        whole = [(e, self.entry[n][0]) for n, e in state if self.entry[n] and e <= self.allowed[self.entry[n][0]]]
        stems = [(e, self.entry[n][0]) for n, e in state if self.entry[n] and self.entry[n][1] and e <= self.allowed[self.entry[n][0]]]
        return min(whole, default=None), min(stems, default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) or nothing."""
        state, stem = self.start, None
        for c in word:
            key = (state, c)
            after = self.moves.get(key)
            if after is None:
                if len(self.moves) > 200_000:
                    self.moves.clear()
                    self.ends.clear()
                after = self.moves[key] = self._move(state, c)
            state = after
            if not state:
                return stem
            end = self.ends.get(state)
            if end is None:
                end = self.ends[state] = self._end(state)
            if end[1] is not None and (stem is None or end[1] < stem):
                stem = end[1]
        whole = self.ends[state][0] if state in self.ends else self._end(state)[0]
        return min((x for x in (whole, stem) if x is not None), default=None)


# ---------------------------------------------------------------- the model


class Model:
    """Lexicon, hit weights, context weights and logistic weights; small and picklable."""

    FEATURES = 7

    def __init__(self):
        self.entries: list[tuple[str, bool]] = []
        self.weight: dict[tuple[int, bool], float] = {}
        self.context: dict[str, float] = {}
        self.beta = np.zeros(self.FEATURES)
        self.mean = np.zeros(self.FEATURES)
        self.scale = np.ones(self.FEATURES)
        self.fitted = False
        self._automaton: Automaton | None = None
        self._known: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_known": {}}

    def hit(self, word: str):
        if self._automaton is None:
            self._automaton = Automaton(self.entries)
        if word not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[word] = self._automaton.match(word)
        return self._known[word]

    def hits(self, text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
        """(word's place, entry, edits) of each hit, and the words."""
        words = WORDS.findall(text.lower())
        known, hit = self._known, self.hit
        return [(i, x[1], x[0]) for i, w in enumerate(words) if (x := known[w] if w in known else hit(w)) is not None], words

    def context_of(self, i: int, words: list[str]) -> float:
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        return max(-3.0, min(3.0, sum(self.context.get(w, 0.0) for w in near)))

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(self.FEATURES)
        found, words = self.hits(text)
        if not found:
            return out
        quoted = quoted_places(text) if QUOTES.search(text) else frozenset()
        plain, best = 0.0, []
        for i, entry, edits in found:
            weight = self.weight.get((entry, edits > 0), 0.0) + self.context_of(i, words)
            if i in quoted:
                out[5] += 1
            else:
                best.append(weight)
                plain += max(weight, 0.0)
            out[2 if edits == 0 else 3] += 1
        out[0] = max(best, default=0.0)
        out[1] = math.log1p(plain)
        out[2:4] = np.log1p(out[2:4])
        out[4] = len(found) / len(words)
        out[5] /= len(found)
        out[6] = 1.0
        return out

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        z = float(((self.features(text or "") - self.mean) / self.scale) @ self.beta[: self.FEATURES] + self.bias)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def quoted_places(text: str) -> frozenset:
    """Places of the words that stand between a pair of quotation marks of one paragraph; a mark that never closes quotes nothing."""
    out, inside, opened, k = set(), False, 0, 0
    for token in re.finditer(r"[\"«»“”„‹›]|\n[ \t]*\n|[^\W_]+", text):
        if QUOTES.match(token.group()):
            if inside:
                out.update(range(opened, k))
            inside, opened = not inside, k
        elif token.group()[0] == "\n":
            inside = False
        else:
            k += 1
    return frozenset(out)


def _log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, prior: float = 0.5) -> float:
    return math.log((toxic + prior) / (n_toxic + 1)) - math.log((clean + prior) / (n_clean + 1))


#: Different endings of a stem that are counted.
ENDINGS = 6


def term_counts(texts: list[str], labels: list[int]) -> list[tuple]:
    """(kind, term, clean texts, toxic texts, some endings) of words (kind False) and of their prefixes."""
    counts: dict[tuple[bool, str], list[int]] = defaultdict(lambda: [0, 0])
    endings: dict[str, set] = defaultdict(set)
    for text, y in zip(texts, labels):
        words = set(WORDS.findall(text.lower()))
        for w in words:
            counts[False, w][y] += 1
            for k in range(4, min(len(w), 8)) if y else ():
                if len(endings[w[:k]]) < ENDINGS:
                    endings[w[:k]].add(w[k:])
        for p in {w[:k] for w in words for k in range(4, min(len(w), 8))}:
            counts[True, p][y] += 1
    return [(kind, term, c, t, sorted(endings[term]) if kind and t else []) for (kind, term), (c, t) in counts.items()]


def least_texts(toxic: int) -> int:
    """Toxic texts of the sample that a term of the lexicon is in at least."""
    return max(3, toxic // 100)


def lexicon(counts: list[tuple], n: dict[int, int]) -> list[tuple[str, bool]]:
    """Terms and stems (prefixes of several words) that mark toxic texts, those of most documents first."""
    found = []
    for kind, term, clean, toxic, endings in counts:
        if toxic < least_texts(n[1]) or kind and len(endings) < ENDINGS:
            continue
        odds = _log_odds(toxic, clean, n[1], n[0])
        if odds > 3 and toxic / n[1] > 20 * (clean + 0.01) / n[0]:
            found.append((-toxic * odds, -len(term), term, kind))
    out: list[tuple[str, bool]] = []
    chosen: set[str] = set()
    for _, _, term, kind in sorted(found):
        if not any(term[:k] in chosen for k in range(4, len(term))):
            out.append((term, kind))
            if kind:
                chosen.add(term)
    return out


def hit_counts(model: Model, texts: list[str], labels: list[int]) -> list[tuple]:
    """(what, key, clean, toxic): texts with a hit of an entry, exact or edited; hits with a word around; hits."""
    counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    for text, y in zip(texts, labels):
        found, words = model.hits(text)
        for e, edited in {(e, d > 0) for _, e, d in found}:
            counts["entry", f"{e}:{int(edited)}"][y] += 1
        for i, _, _ in found:
            counts["hits", ""][y] += 1
            for w in set(words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]):
                counts["near", w][y] += 1
    return [(what, key, c, t) for (what, key), (c, t) in counts.items()]


def weigh(model: Model, counts: list[tuple], n: dict[int, int]) -> None:
    """Weights of hits and of the words around them."""
    got = {(what, key): (c, t) for what, key, c, t in counts}
    for k in range(len(model.entries)):
        clean, toxic = got.get(("entry", f"{k}:0"), (0, 0))
        exact = model.weight[k, False] = _log_odds(toxic, clean, n[1], n[0])
        # a misspelling leans on the entry itself until it has been seen often enough
        clean, toxic = got.get(("entry", f"{k}:1"), (0, 0))
        trust = (toxic + clean) / (toxic + clean + 3)
        model.weight[k, True] = trust * _log_odds(toxic, clean, n[1], n[0]) + (1 - trust) * 0.6 * exact
    # context: words around hits in clean against toxic texts, only where clean hits exist
    total = got.get(("hits", ""), (0, 0))
    if total[0] >= 5:
        for (what, w), (clean, toxic) in got.items():
            if what == "near" and clean + toxic >= LEAST_NEAR:
                model.context[w] = 0.5 * _log_odds(toxic, clean, total[1], total[0], 2.0)


#: Hits that a word stands around at least before it has a weight.
LEAST_NEAR = 5


def regress(model: Model, rows: list[tuple[list[float], int]], odds: float | None = None, rounds: int = 30) -> None:
    """Logistic weights from (features, label); ``odds`` of toxic to clean, if the rows were chosen by class."""
    rows = sorted(rows)  # the sums are the same in any order of rows
    x, y = np.array([f for f, _ in rows]), np.array([y for _, y in rows], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    penalty = np.r_[np.full(z.shape[1] - 1, 1.0), 1e-6]
    for _ in range(rounds):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - y) + penalty * beta
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    model.beta, model.bias = beta[:-1], float(beta[-1])
    if odds:
        model.bias += math.log(odds) - math.log(y.sum() / (len(y) - y.sum()))
    model.fitted = True


def fit(texts: list[str], labels: list[int], odds: float | None = None) -> Model:
    """A model of labelled texts in memory."""
    model = Model()
    distinct = sorted(set(zip(texts, labels)))
    texts, labels = [t for t, _ in distinct], [y for _, y in distinct]
    n = Counter(labels)
    if n[0] and n[1]:
        model.entries = lexicon(term_counts(texts, labels), n)
        weigh(model, hit_counts(model, texts, labels), n)
        regress(model, [(model.features(t).tolist(), y) for t, y in distinct], odds)
    return model


# ---------------------------------------------------------------- on tables


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from at most ``most`` rows of each class that are not held out."""
    bounded_batches(docs.sparkSession)
    named = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    counts = dict(named.groupBy(F.col("toxic").cast("int")).count().filter("count > 0").collect())
    if not counts.get(0) or not counts.get(1):
        return Model()
    chosen = None
    for kind in (0, 1):
        some = named.filter(F.col("toxic").cast("int") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most twice ``most`` ids
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select(text.alias("text"), F.col("toxic").cast("int").alias("toxic")).withColumn("of", F.sha2(F.col("text").cast("binary"), 256))
    sample = rows.repartition("of").dropDuplicates(["of", "toxic"]).select("text", "toxic")
    sample = materialize(sample, "toxic-sample")
    n = {0: 0, 1: 0} | dict(sample.groupBy("toxic").count().collect())
    model = Model()
    if not n[0] or not n[1]:
        return model
    terms = sample.mapInArrow(_counted(term_counts, TERMS), TERMS).groupBy("kind", "term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("endings")))).alias("endings")
    )
    terms = terms.filter((F.col("toxic") >= least_texts(n[1])) & (F.col("toxic") / n[1] > 20 * (F.col("clean") + 0.01) / n[0]))
    terms = terms.filter(~F.col("kind") | (F.size("endings") >= ENDINGS))
    model.entries = lexicon([tuple(r) for r in terms.collect()], n)
    hits = sample.mapInArrow(_counted(partial(hit_counts, model), HITS), HITS).groupBy("what", "key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weigh(model, [tuple(r) for r in hits.filter((F.col("what") != "near") | (F.col("clean") + F.col("toxic") >= LEAST_NEAR)).collect()], n)
    made = sample.mapInArrow(_counted(partial(_features, model), FEATURES), FEATURES).collect()
    regress(model, [(r["features"], r["toxic"]) for r in made], counts[1] / counts[0])
    return model


TERMS = "kind boolean, term string, clean long, toxic long, endings array<string>"
HITS = "what string, key string, clean long, toxic long"
FEATURES = "features array<double>, toxic int"


def _features(model: Model, texts: list[str], labels: list[int]) -> list[tuple]:
    return [(model.features(t).tolist(), y) for t, y in zip(texts, labels)]


def _counted(rows_of, schema: str):
    """Rows that a function makes of each batch of (text, toxic), of about a megabyte."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [
        {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}[f.split(" ")[1]]
        for f in schema.split(", ")
    ]

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, 0, 1 << 20):
                cols = list(zip(*rows_of(batch.column(0).to_pylist(), batch.column(1).to_pylist()))) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, 1, 1 << 20):
                scores = [model.score(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The input's rows whose score is below the threshold, all columns unchanged; no shuffle."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots do not pass through

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, place, 1 << 20):
                clean = [model.score(t) < THRESHOLD for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = None
