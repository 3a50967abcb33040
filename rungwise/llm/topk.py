"""Exact top-k by inner product with pivot-table elimination.

Every vector carries its distances to a fixed set of pivots. For a query q and
a candidate x the triangle inequality gives the lower bound
``max_p |d(q,p) - d(x,p)|`` of their distance, hence an upper bound of their
inner product: ``(|q|^2 + |x|^2 - bound^2) / 2``. Candidates are evaluated in
the order of that bound until it falls below the k-th best score found, which
no later candidate can then reach.

1. Rows are dealt to blocks by their nearest pivot (several blocks where it has
   many rows), so a block is compact; each keeps the least and greatest
   distance to every pivot and its greatest norm.
2. Every query meets a block of its own nearest pivot. Its k-th best score
   there is a floor for all that follows.
3. Query blocks meet those ranges, not the rows: a pair of a query and a block
   whose bound is below the query's floor goes no further.
4. The pairs that remain are joined with the blocks. Candidates whose bound
   reaches the floor are evaluated in the order of the bound until it falls
   below the k-th best score.

``search`` also tells how many of all pairs of rows were evaluated.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; vectors of another length
than the query's are no candidates of it; rows with the query's own id are not
its candidates; rows that repeat a query's id are one query, with the least of
their vectors; repeated rows of other ids each count; ties go to the smaller
id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.llm._shared import materialize, pick

BLOCK = 4096
QUERY_BLOCK = 512
PIVOTS = 32
#: Blocks whose ranges a query block meets at a time.
RANGES = 512
CHUNK = 1024
#: Pivots whose bounds are computed for every pair, and the share of candidates left by them above which the others are not worth their time.
FIRST, TELLING = 8, 0.9
#: Components below this magnitude multiply exactly in double precision (64 dimensions and far more).
EXACT = 1 << 20

FOUND = "query_id long, vec_id long, score long"


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """id, components floor(scale * x) and their number; unusable vectors left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size(x).alias("dim"))


def pivot_table(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    a, p = v.astype(np.float64), pivots.astype(np.float64)
    squared = (a * a).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (a @ p.T)
    return np.sqrt(np.maximum(squared, 0))


def best_of_blocks(qi, q, qd, ci, c, cd, k: int, chunk: int = CHUNK, floor=None) -> tuple[list, int]:
    """(query id, candidate id, score) of each query's k best that reach its floor, and how many products were evaluated."""
    q2, c2 = (q.astype(np.float64) ** 2).sum(1), (c.astype(np.float64) ** 2).sum(1)
    exact = max(np.abs(q).max(), np.abs(c).max()) < EXACT
    qf, cf = (q.astype(np.float64), c.astype(np.float64)) if exact else (q.astype(object), c.astype(object))
    out, evaluated = [], 0
    for i in range(len(qi)):
        least = -np.inf if floor is None else floor[i]
        # a few pivots first; the others only for candidates that those leave, and only where those told some apart
        apart = np.abs(cd[:, :FIRST] - qd[i, :FIRST]).max(axis=1, initial=0.0)
        upper = _upper(q2[i], c2, apart)
        upper[ci == qi[i]] = -np.inf
        some = np.flatnonzero((upper >= least) & (upper > -np.inf))
        if len(some) < TELLING * len(ci):
            upper[some] = _upper(q2[i], c2[some], np.maximum(apart[some], np.abs(cd[some, FIRST:] - qd[i, FIRST:]).max(axis=1, initial=0.0)))
            some = some[upper[some] >= least]
        order = some[np.argsort(-upper[some])]
        ids, scores = np.empty(0, np.int64), np.empty(0, object if not exact else np.float64)
        for at in range(0, len(order), chunk):
            some = order[at : at + chunk]
            if len(scores) == k and scores[-1] > upper[some[0]]:
                break
            evaluated += len(some)
            score = cf[some] @ qf[i]
            if len(scores) == k:
                some, score = some[score >= scores[-1]], score[score >= scores[-1]]
            if len(some):
                ids, scores = np.concatenate([ids, ci[some]]), np.concatenate([scores, score])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
        out += [(int(qi[i]), int(a), int(max(min(int(b), (1 << 63) - 1), -(1 << 63)))) for a, b in zip(ids, scores) if b >= least]
    return out, evaluated


def _upper(q2, c2, apart):
    """The greatest inner product at squared norms and a least distance; rounding of either is far below the margin."""
    return (q2 + c2 - np.maximum(apart - 1e-6 * (1 + apart), 0) ** 2) / 2 + 1.0 + 1e-9 * (q2 + c2)


BLOCKS = "dim int, home int, sub int, ids binary, v binary, d binary"


def _packed(rows: DataFrame, size: int, table: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of about ``size`` rows with the same nearest pivot: ids, components, pivot distances, as bytes."""

    def nearest(batches):
        for pdf in batches:
            home = np.zeros(len(pdf), np.int32)
            for dim, part in pdf.reset_index(drop=True).groupby("dim"):
                home[part.index] = pivot_table(np.array(part["v"].tolist(), np.int64), table[int(dim)]).argmin(1)
            yield pdf.assign(home=home)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), dtype=np.int64)
        d = pivot_table(v, table[int(pdf["dim"].iloc[0])])
        first = {c: pdf[c].iloc[:1] for c in ("dim", "home", "sub")}
        return pd.DataFrame(first | {"ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()], "d": [d.tobytes()]})

    at_home = rows.mapInPandas(nearest, "vec_id long, v array<long>, dim int, home int")
    counts = at_home.groupBy("dim", "home").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("subs"))
    counts = F.broadcast(materialize(counts, "topk-homes"))  # a row for each pivot
    dealt = at_home.join(counts, ["dim", "home"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("subs")).cast("int"))
    return dealt.groupBy("dim", "home", "sub").applyInPandas(run, BLOCKS)


def _arrays(ids: bytes, v: bytes, d: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(ids, np.int64)
    return n, np.frombuffer(v, np.int64).reshape(len(n), -1), np.frombuffer(d, np.float64).reshape(len(n), -1)


def search(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score of all that may be among the k best; evaluated: pairs of rows whose product was computed)."""
    spark = rows.sparkSession
    vectors = materialize(usable(pick(rows, "vec_id", "embedding"), scale), "topk-vectors")
    chosen = vectors.groupBy("dim").agg(F.array_distinct(F.array(*[F.min_by("v", F.xxhash64("vec_id", F.lit(i))) for i in range(pivots)])).alias("pivots"))
    table = {r["dim"]: np.array(r["pivots"], dtype=np.int64) for r in chosen.collect()}  # a fixed number of pivots for each length of vectors
    if not table:
        none = spark.createDataFrame([], FOUND)
        return none, none.select(F.col("score").alias("evaluated"))
    c = materialize(_packed(vectors, BLOCK, table), "topk-blocks")
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    q = _packed(queries, QUERY_BLOCK, table).select("dim", "home", F.col("sub").alias("qsub"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "v", "d")])

    def seed(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qi, qv, qd = _arrays(r.q_ids, r.q_v, r.q_d)
                got, n = best_of_blocks(qi, qv, qd, *_arrays(r.ids, r.v, r.d), k) if r.ids is not None else ([], 0)
                scores: dict[int, list[int]] = {}
                for query_id, _, score in got:
                    scores.setdefault(query_id, []).append(score)
                floor = np.array([min(s) if len(s := scores.get(i, [])) == k else -np.inf for i in qi.tolist()])
                yield pd.DataFrame({"dim": [r.dim], "home": [r.home], "q_ids": [r.q_ids], "q_v": [r.q_v], "q_d": [r.q_d], "floor": [floor.tobytes()], "found": [got], "evaluated": [n]})

    seeded = q.join(c.filter("sub = 0").select("dim", "home", "ids", "v", "d"), ["dim", "home"], "left").mapInPandas(
        seed, "dim int, home int, q_ids binary, q_v binary, q_d binary, floor binary, found array<struct<query_id: long, vec_id: long, score: long>>, evaluated long"
    )
    seeded = materialize(seeded, "topk-seeds")

    def ranges(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                _, v, d = _arrays(r.ids, r.v, r.d)
                out.append((r.dim, r.home, r.sub, d.min(0).tolist(), d.max(0).tolist(), float((v.astype(np.float64) ** 2).sum(1).max())))
            yield pd.DataFrame(out, columns=["dim", "c_home", "c_sub", "lo", "hi", "norm"])

    spans = c.mapInPandas(ranges, "dim int, c_home int, c_sub int, lo array<double>, hi array<double>, norm double")
    spans = materialize(spans, "topk-ranges")
    parts = F.ceil(F.lit(max(1, spans.count())) / RANGES).cast("int")
    spans = spans.withColumn("part", F.pmod(F.xxhash64("c_home", "c_sub"), parts)).groupBy("dim", "part").agg(F.collect_list(F.struct("c_home", "c_sub", "lo", "hi", "norm")).alias("spans"))

    def reaching(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                qi, qv, qd = _arrays(r.q_ids, r.q_v, r.q_d)
                q2, floor = (qv.astype(np.float64) ** 2).sum(1), np.frombuffer(r.floor, np.float64)
                out = []
                for s in r.spans:
                    if s["c_home"] == r.home and s["c_sub"] == 0:  # evaluated already
                        continue
                    apart = np.maximum(np.array(s["lo"]) - qd, qd - np.array(s["hi"])).max(1).clip(0)
                    go = _upper(q2, s["norm"], apart) >= floor
                    if go.any():
                        out.append((r.dim, s["c_home"], s["c_sub"], qi[go].tobytes(), qv[go].tobytes(), qd[go].tobytes(), floor[go].tobytes()))
                yield pd.DataFrame(out, columns=["dim", "home", "sub", "q_ids", "q_v", "q_d", "floor"])

    met = seeded.join(spans, "dim").mapInPandas(reaching, "dim int, home int, sub int, q_ids binary, q_v binary, q_d binary, floor binary")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                got, n = best_of_blocks(*_arrays(r.q_ids, r.q_v, r.q_d), *_arrays(r.ids, r.v, r.d), k, floor=np.frombuffer(r.floor, np.float64))
                yield pd.DataFrame({"found": [got], "evaluated": [n]})

    rest = met.join(c, ["dim", "home", "sub"]).mapInPandas(run, "found array<struct<query_id: long, vec_id: long, score: long>>, evaluated long")
    both = materialize(seeded.select("found", "evaluated").unionByName(rest), "topk-found")
    return both.select(F.explode("found").alias("f")).select("f.query_id", "f.vec_id", "f.score"), both.select("evaluated")


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id ``every`` divides."""
    found, _ = search(rows, k, every, scale, pivots)
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id")))
    out = found.groupBy("query_id").agg(F.slice(best, 1, k).alias("best")).select("query_id", F.posexplode("best"))
    return out.select(
        "query_id", (F.col("pos") + 1).cast(T.IntegerType()).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.neg")).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
