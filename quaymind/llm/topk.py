"""Exact top-k inner products by a pivot-distance index.

Every vector gets one more component that brings all of them to the same
length; then the largest inner product is the smallest distance, and the
triangle inequality holds.  Pivots are fitted on a bounded sample.  The index
keys each vector by its nearest pivot and the distance to it, and is written
once, range-partitioned and sorted by (pivot, distance): every partition holds
whole annuli, and a crowded annulus is split over partitions by id.

A search runs over slices of queries.  First each query looks at the annulus
that its own key falls into; the k-th best score there is a lower bound.  Then
every index partition expands, per pivot, the sorted annuli on both sides of
the query's distance and stops where the triangle inequality shows that
nothing further out can reach the bound.  A partition returns at most k rows
per query, and a final window keeps the k best.

Scores are integers; bounds are taken with a margin, so rounding never loses a
row.

Defined cases: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; shorter vectors count as padded with
zeros; repeated rows are rows of their own: each is a candidate, also of a query
with the same id, and each repeat of a query is a query that gets its own k
rows; equal scores go to the smaller id; a query with fewer than k candidates
returns all; an empty table gives no rows.
Components that would make a score exceed 2**53 are computed with Python
integers, and scores are cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymind.llm.common import materialize, project
from quaymind.session import ship_package

TOP = 5
QUERY_EVERY = 50
#: The pivots are fitted on at most this many vectors.
SAMPLE = 4_096
PIVOTS = 32
#: Rows of one annulus block, the unit of expansion.
BLOCK = 256
#: Bytes of queries that are broadcast at once.
SLICE_BYTES = 16 << 20
#: Index rows in one partition, about.
PARTITION_ROWS = 50_000


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id and the components floor(256 * x) of the vectors that take part.

    ``row`` tells repeated rows apart; it holds once the table is written.
    """
    rows = project(df, {id_col: "bigint", vector_col: "array<double>"}).toDF("vec_id", "raw")
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("raw", lambda x: F.floor(x * 256.0).cast("double"))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull()).where(F.coalesce(finite, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", scaled.alias("v")))


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """Centres of a few k-means rounds that start from far-apart sample vectors."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen].astype(float)
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        for p in range(len(centres)):
            if (near == p).any():
                centres[p] = sample[near == p].mean(axis=0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    """The vectors with the component that brings them to the common length."""
    return np.hstack([v, np.sqrt(np.maximum(radius2 - (v * v).sum(axis=1), 0.0))[:, None]])


def _keyed(dim: int, radius2: float, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            d = _distances(_lifted(v, radius2), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)),
                 pa.array(d[np.arange(len(v)), near])], names=["row", "vec_id", "v", "pivot", "dist"])
    return run


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return q @ x.T
    return np.array([[max(-2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(s, t)))) for t in x] for s in q],
                    dtype=object).reshape(len(q), len(x))


class _Best:
    """The k best (score, id) of each query of a slice, best first; ``own`` are the queries' own rows."""

    def __init__(self, own: np.ndarray, k: int, bound: np.ndarray, exact: bool):
        self.own, self.k, self.bound = own, k, bound
        kind = np.float64 if exact else object
        self.score = np.full((len(own), k), -np.inf, dtype=kind)
        self.vec = np.full((len(own), k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, vec_ids: np.ndarray, at: np.ndarray) -> None:
        fits = (scores >= self.bound[rows][:, None]).astype(bool) & (self.own[rows][:, None] != at[None, :])
        some = fits.any(axis=1)
        if not some.any():
            return
        rows, scores = rows[some], np.where(fits[some], scores[some], -np.inf)
        score = np.hstack([self.score[rows], scores])
        vec = np.hstack([self.vec[rows], np.broadcast_to(vec_ids, (len(rows), len(vec_ids)))])
        if score.shape[1] > 8 * self.k and score.dtype != object:
            # only what reaches the k-th largest score can stay; ties there are all kept until the sort
            cut = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            for n, r in enumerate(rows):
                at = np.flatnonzero((score[n] >= cut[n]) & (score[n] > -np.inf))
                order = at[np.lexsort((vec[n][at], -score[n][at]))][:self.k]
                self._put(r, score[n][order], vec[n][order])
        else:
            for n, r in enumerate(rows):
                at = sorted((c for c in range(score.shape[1]) if score[n, c] > -np.inf),
                            key=lambda c: (-score[n, c], vec[n, c]))[:self.k]
                self._put(r, score[n][at], vec[n][at])

    def _put(self, r: int, score: np.ndarray, vec: np.ndarray) -> None:
        self.score[r], self.vec[r] = -np.inf, np.iinfo(np.int64).max
        self.score[r, :len(score)], self.vec[r, :len(vec)] = score, vec
        if len(score) == self.k and score[-1] > self.bound[r]:
            self.bound[r] = score[-1]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero((self.score > -np.inf).astype(bool))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.own[q]), pa.array(ids[q]), pa.array(self.vec[q, at]),
             pa.array([int(s) for s in self.score[q, at]], pa.int64())], names=["query", "query_id", "vec_id", "score"])


def _search(queries, pivots: np.ndarray, dim: int, radius2: float, k: int, exact: bool, seed_only: bool):
    """Scan one sorted index partition for all queries of a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, q, bound = queries.value
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        to_pivot = _distances(lifted, pivots)
        # nothing further from the query than this can reach the bound: |q-x|^2 = |q|^2 + R^2 - 2 q.x
        q2 = (q * q).sum(axis=1)
        home = _distances(_lifted(q, radius2), pivots)
        home_pivot, home_dist = home.argmin(axis=1), home.min(axis=1)
        best = _Best(own, k, bound.copy(), exact)
        slack = 1e-6 * (radius2 + 1.0)
        for batch in batches:
            v, vec = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            at = batch.column("row").to_numpy()
            pivot, dist = batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            edges = np.flatnonzero(np.diff(pivot)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(pivot)]):
                if lo == hi:
                    continue
                p, d = int(pivot[lo]), dist[lo:hi]
                blocks = [(lo + s, min(lo + s + BLOCK, hi)) for s in range(0, hi - lo, BLOCK)]
                if seed_only:
                    near = [(s, e, np.flatnonzero((home_pivot == p) & (home_dist >= dist[s]) & (home_dist <= dist[e - 1])))
                            for s, e in blocks]
                    for s, e, rows in near:
                        if len(rows):
                            best.add(rows, _scores(q[rows], v[s:e], exact), vec[s:e], at[s:e])
                    continue
                # annuli from the query's own distance outwards: nearest ring first
                inner, outer = np.array([dist[s] for s, _ in blocks]), np.array([dist[e - 1] for _, e in blocks])
                gap = np.maximum(0.0, np.maximum(inner[None, :] - to_pivot[:, p][:, None],
                                                 to_pivot[:, p][:, None] - outer[None, :]))
                for b in np.argsort(gap.mean(axis=0), kind="stable"):
                    reach = (q2 + radius2 + slack - gap[:, b] ** 2) / 2.0
                    rows = np.flatnonzero(reach + slack >= best.bound)
                    if len(rows):
                        s, e = blocks[b]
                        best.add(rows, _scores(q[rows], v[s:e], exact), vec[s:e], at[s:e])
        yield best.batch(ids)
    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int = TOP, query_every: int = QUERY_EVERY, pivots: int = PIVOTS, sample: int = SAMPLE,
          slice_bytes: int = SLICE_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query."""
    spark = df.sparkSession
    ship_package(spark)
    vectors = materialize(quantized(df, id_col, vector_col), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows, dim, radius2, largest = vectors.agg(
        F.count(F.lit(1)), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", F.abs)))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not rows:
        return empty
    dim, radius2, largest = max(dim, 1), radius2 or 0.0, largest or 0.0
    exact = dim * largest * largest < 2.0**53
    if not np.isfinite(radius2):
        radius2 = float(np.finfo(float).max) / 4
    share = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    picked = vectors.where(share < sample / rows).limit(sample).select("v").toArrow()
    fitted = _matrix(picked.column("v").combine_chunks(), dim) if picked.num_rows else np.zeros((1, dim))
    centres = fit_pivots(_lifted(fitted, radius2), pivots)

    parts = max(1, -(-rows // PARTITION_ROWS), min(spark.sparkContext.defaultParallelism, rows // BLOCK))
    order = ["pivot", "dist", "vec_id", "row"]
    index = materialize(
        vectors.mapInArrow(_keyed(dim, radius2, centres), "row long, vec_id long, v array<double>, pivot int, dist double")
        .repartitionByRange(parts, *order).sortWithinPartitions(*order), "pivot-index")

    asked = vectors.where(F.col("vec_id") % query_every == 0)
    wanted = asked.count()
    slices = max(1, -(-wanted * dim * 8 // slice_bytes))
    out = None
    for n in range(slices):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == n).toArrow()
        if not part.num_rows:
            continue
        own, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
        q = _matrix(part.column("v").combine_chunks(), dim)
        sc, schema = spark.sparkContext, "query long, query_id long, vec_id long, score long"
        first = sc.broadcast((own, ids, q, np.full(len(ids), -np.inf)))
        seeds = _ranked(index.mapInArrow(_search(first, centres, dim, radius2, k, exact, True), schema), k)
        known = {r["query"]: r["s"] for r in seeds.where(F.col("rank") == k).select(
            "query", F.col("score").alias("s")).collect()}
        bound = np.array([known.get(int(i), -np.inf) for i in own], dtype=float)
        again = sc.broadcast((own, ids, q, bound if exact else np.full(len(ids), -np.inf)))
        hits = _ranked(index.mapInArrow(_search(again, centres, dim, radius2, k, exact, False), schema), k)
        hits = materialize(hits.select("query_id", "rank", "vec_id", "score"), "topk")
        first.destroy()
        again.destroy()
        out = hits if out is None else out.unionByName(hits)
    return empty if out is None else out


def op10_topk(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.own <> c.own),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
