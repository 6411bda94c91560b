"""Vector operators: encoder (V1), L2 normalisation (V2), exact top-k
inner-product search (V3) and store build (V5 lives in plans).

V3 never collects the corpus.  Two physical paths, same result:

* broadcast path -- a small query set is shipped once as a broadcast numpy
  block, and every corpus partition computes a blocked matrix product plus a
  local top-k in ``mapInArrow``; only k candidates per (query, partition)
  leave the task.
* block path -- a larger query set is cut into blocks and stays on the
  executors; a task holds one block of queries and streams the corpus past
  it (the block matrix product layout), so k rows per query leave it.  Fewer
  blocks than cores cut the corpus as well.

Scores are first computed in float32; what an error bound cannot rule out is
scored again in float64, so the result is that of float64.  Where several
tasks hold candidates of a query, ``row_number() <= k`` (W1) ranks them; Spark
plans that as a partial ``WindowGroupLimit`` before the shuffle and a final
one after.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymind.session import ship_package

SCORE_DECIMALS = 6
BROADCAST_QUERY_BYTES = 1024 * 1024         # a query set of at most so many bytes is shipped to every task
CORPUS_BATCH_ROWS = 1024                    # corpus rows scored at once in a task: a tile's scores stay in the cache
QUERY_TILE = 512                            # queries scored at once in a task
BLOCK_QUERIES = 65_536                      # queries of a block, about (a task's memory)
MIN_BLOCK_QUERIES = 2048                    # smaller blocks read the corpus too often for what they score
RESCORE_BYTES = 16 * 1024 * 1024            # vectors gathered at once for exact scores
EMIT_ROWS = 65_536                          # rows per Arrow batch out of a task


def l2_normalize(col: Column | str) -> Column:
    """V2: unit-length vector; a zero (or empty) vector is returned unchanged."""
    v = F.col(col) if isinstance(col, str) else col
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def _matrix(arr: pa.Array, dim: int) -> np.ndarray:
    """Arrow list column -> dense (rows x dim) matrix, float32 where the column is, else float64."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    dtype = np.float32 if arr.type.value_type == pa.float32() else np.float64
    if len(arr) == 0:
        return np.zeros((0, dim), dtype)
    offsets = arr.offsets.to_numpy()
    lens = np.diff(offsets)
    if arr.null_count or (lens != dim).any():
        raise ValueError(f"every vector must have exactly {dim} values")
    flat = arr.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return flat.astype(dtype, copy=False).reshape(len(arr), dim)


def _ints(arr: pa.Array) -> np.ndarray:
    return arr.to_numpy(zero_copy_only=False).astype(np.int64)


def _few_true(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask that is mostly false: eight values are looked at as one."""
    whole = len(mask) // 8 * 8
    at = np.flatnonzero(mask[:whole].view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[mask[at]], whole + np.flatnonzero(mask[whole:])])


def _first_k(group: np.ndarray, scores: np.ndarray, keys: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are among the first k of their group by (score desc, keys asc), in that order, and their places."""
    order = np.lexsort([*reversed(keys), -scores, group])
    g = group[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g))))
    kept = place < k
    return order[kept], place[kept]


class _TopK:
    """Running exact top-k of (score, key columns) of a tile of queries inside one task.

    Ranking is on the rounded float64 score, ties broken by key.  ``floor`` is
    what a query's k-th score is at least: what lies below is in no answer.
    """

    def __init__(self, queries: np.ndarray, bound: np.ndarray, k: int, nkeys: int):
        self.queries, self.k, self.nkeys = queries, k, nkeys
        self.norms = np.linalg.norm(queries.astype(np.float64), axis=1)
        self.narrow = queries.astype(np.float32, copy=False) if np.isfinite(self.norms).all() and (self.norms < 1e18).all() else None
        self.floor = bound.astype(np.float64)
        self.kept = [np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64) for _ in range(nkeys)]]
        self.fresh: list[list[np.ndarray]] = []
        self.n_fresh = 0

    def _cells(self, mat: np.ndarray, narrow: np.ndarray | None, longest: float,
               room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (query, corpus row) cells that may hold an answer.

        ``narrow`` is ``mat`` in float32 and column by column; ``room`` is where scores are put."""
        if narrow is None or self.narrow is None:
            with np.errstate(over="ignore", invalid="ignore"):
                scores = self.queries.astype(np.float64) @ mat.astype(np.float64).T
            scores[~np.isfinite(scores)] = -np.inf
            unit = 2.0 ** -53
        else:
            shape = (len(self.narrow), len(mat))
            scores = np.matmul(self.narrow, narrow, out=room[:shape[0] * shape[1]].reshape(shape))
            unit = 2.0 ** -24
        # error of rounding both vectors and of summing up, and the rounding to SCORE_DECIMALS
        slack = 2 * (mat.shape[1] + 4) * unit * self.norms * longest + 10.0 ** -SCORE_DECIMALS
        cut = self.floor - slack
        fresh = np.flatnonzero(~np.isfinite(self.floor))
        if len(fresh) and scores.shape[1] > self.k:
            kth = np.partition(scores[fresh], scores.shape[1] - self.k, axis=1)[:, -self.k]
            cut[fresh] = kth - 2 * slack[fresh]
        cut = np.nextafter(cut.astype(scores.dtype), scores.dtype.type(-np.inf))
        # few queries find anything in a slice: the others are told by their best score
        some = np.flatnonzero(scores.max(axis=1) >= cut)
        rows, cols = np.divmod(_few_true((scores[some] >= cut[some, None]).ravel()), scores.shape[1])
        return some[rows], cols

    def add(self, mat: np.ndarray, narrow: np.ndarray | None, longest: float, keys: list[np.ndarray],
            room: np.ndarray) -> None:
        rows, cols = self._cells(mat, narrow, longest, room)
        step = max(1, RESCORE_BYTES // (8 * max(1, mat.shape[1])))
        for at in range(0, len(rows), step):
            r, c = rows[at:at + step], cols[at:at + step]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.round(np.einsum("ij,ij->i", self.queries[r].astype(np.float64), mat[c].astype(np.float64)),
                                 SCORE_DECIMALS)
            fits = np.isfinite(exact) & (exact >= self.floor[r])
            r, c = r[fits], c[fits]
            self.fresh.append([r, exact[fits], *[x[c] for x in keys]])
            self.n_fresh += len(r)
            if self.n_fresh >= self.k * len(self.queries):
                self._fold()

    def _fold(self) -> None:
        rows, scores, *keys = [np.concatenate(x) for x in zip(self.kept, *self.fresh)]
        self.fresh, self.n_fresh = [], 0
        best, place = _first_k(rows, scores, keys, self.k)
        self.kept = [x[best] for x in (rows, scores, *keys)]
        last = place == self.k - 1
        at = self.kept[0][last]
        self.floor[at] = np.maximum(self.floor[at], self.kept[1][last])

    def rows(self, query_ids: np.ndarray) -> list[np.ndarray]:
        self._fold()
        return [query_ids[self.kept[0]], *self.kept[1:]]


BOUND_BYTES = 256 << 20  # a larger corpus is searched in two phases (broadcast path)
BOUND_STEP = 16  # one corpus vector in so many gives the first phase's bounds


def _tiles(qmat: np.ndarray, bound: np.ndarray, k: int, nkeys: int) -> list[_TopK]:
    return [_TopK(qmat[s:s + QUERY_TILE], bound[s:s + QUERY_TILE], k, nkeys) for s in range(0, len(qmat), QUERY_TILE)]


def _score(tops: list[_TopK], mat: np.ndarray, keys: list[np.ndarray]) -> None:
    """Score corpus rows against all queries, a tile and a slice at a time: a task holds few scores."""
    # a vector that holds a non-finite value has no finite score
    fine = np.isfinite(mat).all(axis=1)
    if not fine.all():
        mat, keys = mat[fine], [c[fine] for c in keys]
    room = np.empty(QUERY_TILE * CORPUS_BATCH_ROWS, np.float32)
    for start in range(0, len(mat), CORPUS_BATCH_ROWS):
        part = mat[start:start + CORPUS_BATCH_ROWS]
        longest = float(np.linalg.norm(part.astype(np.float64), axis=1).max())
        narrow = np.ascontiguousarray(part.T, np.float32) if longest < 1e18 else None
        of_part = [c[start:start + CORPUS_BATCH_ROWS] for c in keys]
        for t in tops:
            t.add(part, narrow, longest, of_part, room)


def _emit(tops: list[_TopK], qids: np.ndarray, k: int, ranked: bool,
          out_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """query id, rank (if asked for), keys and score of the tiles' answers, a tile at a time.

    Rows of one query id are ranked together: where ranks are asked for, ``qids`` ascend, and a tile's last
    id waits for the next tile."""
    held = None
    for i, t in enumerate(tops):
        mine = qids[i * QUERY_TILE:(i + 1) * QUERY_TILE]
        found = t.rows(mine)
        t.kept = []
        if ranked:
            if held:
                found = [np.concatenate(x) for x in zip(held, found)]
            best, place = _first_k(found[0], found[1], found[2:], k)
            found = [x[best] for x in found]
            wait = (found[0] == mine[-1]) & (i + 1 < len(tops))
            held = [x[wait] for x in found]
            found, place = [x[~wait] for x in found], place[~wait]
        ids, scores, *keys = found
        cols = [ids, *([place + 1] if ranked else []), *keys, scores]
        for at in range(0, len(ids), EMIT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + EMIT_ROWS], f.type) for c, f in zip(cols, out_schema)],
                                             schema=out_schema)


def _arrow_topk_fn(bq, k: int, key_cols: list[str], vec_col: str,
                   out_schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qmat, bound = bq.value
        if len(qids) == 0:
            return
        tops = None
        for batch in batches:
            tops = tops or _tiles(qmat, bound, k, len(key_cols))
            _score(tops, _matrix(batch.column(vec_col), qmat.shape[1]), [_ints(batch.column(c)) for c in key_cols])
        if tops:
            yield from _emit(tops, qids, k, False, out_schema)
    return fn


def _arrow_cell_fn(k: int, dim: int, nkeys: int, ranked: bool,
                   out_schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One cell of the grid: its queries come first (``_side`` 0), then the corpus rows stream past them."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, tops = [], [], None
        for batch in batches:
            asked = int(np.count_nonzero(batch.column("_side").to_numpy(zero_copy_only=False) == 0))
            if asked:
                mine = batch.slice(0, asked)
                ids.append(_ints(mine.column("_k0")))
                vecs.append(_matrix(mine.column("_v"), dim))
            rest = batch.slice(asked)
            if not ids or not rest.num_rows:
                continue
            if tops is None:
                qids, qmat = np.concatenate(ids), np.concatenate(vecs)
                order = np.argsort(qids, kind="stable")
                qids, qmat, vecs = qids[order], qmat[order], []
                tops = _tiles(qmat, np.full(len(qids), -np.inf), k, nkeys)
            _score(tops, _matrix(rest.column("_v"), dim), [_ints(rest.column(f"_k{i}")) for i in range(nkeys)])
        if tops:
            yield from _emit(tops, qids, k, ranked, out_schema)
    return fn


def _rank(cands: DataFrame, k: int, query_id: str, key_cols: list[str]) -> DataFrame:
    """Rank 1..k per query, score descending, ties by key."""
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *[F.col(c) for c in key_cols])
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .withColumn("rank", F.col("rank").cast("long"))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, *,
                query_id: str = "query_id", query_vec: str = "embedding",
                key_cols: tuple[str, ...] | list[str] = ("product_id", "variant_id"),
                corpus_vec: str = "embedding",
                broadcast_bytes: int = BROADCAST_QUERY_BYTES, bound_bytes: int = BOUND_BYTES) -> DataFrame:
    """V3: exact maximum-inner-product top-k.

    Up to ``broadcast_bytes`` of queries (as float64) are broadcast, more are
    dealt over tasks (see :func:`_block_topk`).  On the broadcast path a
    corpus of more than ``bound_bytes`` (by Spark's estimate) is searched in
    two phases.  The first ranks one vector in ``BOUND_STEP``, picked by its
    key; the k-th score there is a lower bound of the query's k-th score.  The
    second scores all vectors, and tasks emit only what reaches the bound:
    about k x ``BOUND_STEP`` candidates a query, however many tasks there are.

    Returns ``query_id, rank, <key_cols>, score`` with rank 1..min(k, |corpus|);
    score is the float64 inner product rounded to 6 decimals; equal scores
    are ordered by the key columns.  Vectors that hold non-finite values take
    no part.  ``k <= 0`` or an empty corpus gives no rows.
    """
    key_cols = list(key_cols)
    spark = corpus.sparkSession
    ship_package(spark)
    schema = f"{query_id} bigint, " + ", ".join(f"{c} bigint" for c in key_cols) + ", score double"
    nothing = spark.createDataFrame([], schema).withColumn("rank", F.lit(1).cast("long")).select(
        query_id, "rank", *key_cols, "score")
    if k <= 0:
        return nothing
    q = queries.select(F.col(query_id).cast("long").alias(query_id), F.col(query_vec).alias("_qv"))
    first = q.select(F.size("_qv").alias("d")).head(1)
    if not first:
        return nothing
    dim = int(first[0]["d"])
    corpus_sel = corpus.select(*[F.col(c).cast("long").alias(c) for c in key_cols],
                               F.col(corpus_vec).alias("_cv"))
    asked = q.count()
    if asked * dim * 8 > broadcast_bytes:
        found = _block_topk(q, corpus_sel, k, dim, asked, query_id, key_cols)
    else:
        tbl = q.toArrow()
        two_phases = int(str(corpus_sel._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > bound_bytes
        bounds = _lower_bounds(tbl, corpus_sel, k, dim, query_id, key_cols) if two_phases else None
        found = _rank(_broadcast_candidates(tbl, corpus_sel, k, dim, query_id, key_cols, bounds), k, query_id, key_cols)
    return found.select(query_id, "rank", *key_cols, "score")


def _block_topk(q: DataFrame, corpus: DataFrame, k: int, dim: int, asked: int, query_id: str,
                key_cols: list[str]) -> DataFrame:
    """The block path: a grid of query blocks x corpus parts, one task a cell.

    A query goes to the cells of its block, a corpus row to the cells of its
    part.  There are as many parts as keep all cores busy, one if the blocks
    do; a query's answer is then whole in its cell and is ranked there.  A
    task's memory is bounded by ``BLOCK_QUERIES``, not by either table.
    """
    spark = corpus.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = max(math.ceil(asked / BLOCK_QUERIES), min(cores, math.ceil(asked / MIN_BLOCK_QUERIES)))
    blocks = math.ceil(blocks / cores) * cores if blocks > cores else blocks  # full rounds of tasks
    parts = math.ceil(cores / blocks)
    # of equal vectors only the k with the smallest keys can be in an answer; the hash spares the sort most vectors
    copies = Window.partitionBy(F.xxhash64("_cv"), "_cv").orderBy(*[F.col(c) for c in key_cols])
    rows = corpus.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k)
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64(*key_cols), F.lit(parts)).cast("int")
    names = [f"_k{i}" for i in range(len(key_cols))]
    left = q.select(F.explode(F.sequence(block * parts, block * parts + F.lit(parts - 1))).alias("_cell"), F.lit(0).alias("_side"),
                    F.col(query_id).alias("_k0"), *[F.lit(0).cast("long").alias(n) for n in names[1:]], F.col("_qv").alias("_v"))
    right = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * parts + part)).alias("_cell"),
                        F.lit(1).alias("_side"), *[F.col(c).alias(n) for c, n in zip(key_cols, names)], F.col("_cv").alias("_v"))
    cells = left.unionByName(right).repartitionById(blocks * parts, F.col("_cell")).sortWithinPartitions("_side")
    ranked = parts == 1
    fields = [query_id, *(["rank"] if ranked else []), *key_cols]
    out_schema = pa.schema([*[(c, pa.int64()) for c in fields], ("score", pa.float64())])
    found = cells.mapInArrow(_arrow_cell_fn(k, dim, len(key_cols), ranked, out_schema),
                             ", ".join(f"`{c}` bigint" for c in fields) + ", score double")
    return found if ranked else _rank(found, k, query_id, key_cols)


def _lower_bounds(tbl: pa.Table, corpus: DataFrame, k: int, dim: int, query_id: str, key_cols: list[str]) -> np.ndarray:
    """The k-th score of every query of a slice among a share of the corpus; -inf where that holds fewer than k.

    The share itself is ranked with the bounds of a share of it, so its tasks
    emit no more than those of the whole corpus."""
    share = F.pmod(F.xxhash64(*key_cols), F.lit(BOUND_STEP ** 2))
    bounds = None
    for part in (corpus.where(share == 0), corpus.where(F.pmod(share, F.lit(BOUND_STEP)) == 0)):
        ranked = _rank(_broadcast_candidates(tbl, part, k, dim, query_id, key_cols, bounds), k, query_id, key_cols)
        # one score a query: as bounded as the slice
        kth = {r[0]: r[1] for r in ranked.where(F.col("rank") == k).select(query_id, "score").collect()}
        bounds = np.array([kth.get(int(i), -np.inf) for i in tbl.column(query_id).to_numpy()], dtype=np.float64)
    return bounds


def _broadcast_candidates(tbl: pa.Table, corpus: DataFrame, k: int, dim: int, query_id: str, key_cols: list[str],
                          bounds: np.ndarray | None = None) -> DataFrame:
    """What every task holds to be among the k best, and not below the queries' bounds."""
    spark = corpus.sparkSession
    qids = tbl.column(query_id).to_numpy().astype(np.int64)
    qmat = _matrix(tbl.column("_qv"), dim)
    bq = spark.sparkContext.broadcast((qids, qmat, np.full(len(qids), -np.inf) if bounds is None else bounds))
    out_schema = pa.schema([(query_id, pa.int64())] + [(c, pa.int64()) for c in key_cols]
                           + [("score", pa.float64())])
    spark_schema = f"{query_id} bigint, " + ", ".join(f"{c} bigint" for c in key_cols) + ", score double"
    fn = _arrow_topk_fn(bq, k, key_cols, "_cv", out_schema)
    return corpus.mapInArrow(fn, spark_schema)


def hash_encoder(dim: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Deterministic stand-in encoder: hashed word/bigram counts, L2-normalised.

    No sentence model is installed; any callable ``pd.Series[str] ->
    pd.Series[list[float]]`` can replace it in ``encode_texts``.
    """
    import re
    import xxhash

    word = re.compile(r"[a-z0-9]+")

    @lru_cache(maxsize=200_000)
    def place(tok: str) -> int:
        """Column of a token; the second half of the columns counts downwards."""
        h = xxhash.xxh64_intdigest(tok)
        return h % dim if (h >> 32) & 1 else dim + h % dim

    def encode(texts: pd.Series) -> pd.Series:
        cells: list[int] = []
        for i, t in enumerate(texts.fillna("").tolist()):
            toks = word.findall(t.lower())
            at = 2 * dim * i
            cells += [at + place(tok) for tok in toks]
            cells += [at + place(a + " " + b) for a, b in zip(toks, toks[1:])]
        counts = np.bincount(np.array(cells, np.int64), minlength=2 * dim * len(texts)).reshape(len(texts), 2 * dim)
        out = (counts[:, :dim] - counts[:, dim:]).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.where(norms > 0, out / np.where(norms > 0, norms, 1), out)
        return pd.Series(list(out))
    return encode


def encode_texts(df: DataFrame, text_col: str, out_col: str = "embedding",
                 encoder_factory: Callable[[], Callable[[pd.Series], pd.Series]] | None = None,
                 batch_size: int = 32) -> DataFrame:
    """V1: text -> L2-normalised float32 vector, in Arrow batches.

    ``encoder_factory`` runs once per Python worker (model load), then each
    Arrow batch is encoded in slices of ``batch_size`` rows.
    """
    factory = encoder_factory or (lambda: hash_encoder(64))
    ship_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = factory()
        for s in batches:
            parts = [enc(s.iloc[i:i + batch_size]) for i in range(0, len(s), batch_size)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)

    return df.withColumn(out_col, _encode(F.col(text_col)))
