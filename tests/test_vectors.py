"""Exact top-k search against numpy brute force; both physical paths."""

import numpy as np
import pytest

from quaymind.operators.vectors import vector_topk


def brute(q, c, k):
    out = []
    for qi, qv in q:
        scores = [(round(float(np.dot(np.asarray(qv, np.float64), np.asarray(cv, np.float64))), 6), pid, vid)
                  for pid, vid, cv in c]
        scores.sort(key=lambda t: (-t[0], t[1], t[2]))
        out += [(qi, r + 1, pid, vid, s) for r, (s, pid, vid) in enumerate(scores[:k])]
    return sorted(out)


def frames(spark, q, c):
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q], "query_id bigint, embedding array<float>")
    cdf = spark.createDataFrame([(p, v, [float(x) for x in e]) for p, v, e in c],
                                "product_id bigint, variant_id bigint, embedding array<float>").repartition(3)
    return qdf, cdf


@pytest.mark.parametrize("bbytes", [64 * 1024 * 1024, 2000])  # one slice of queries, then several
def test_topk_matches_numpy(spark, bbytes):
    rng = np.random.default_rng(7)
    c = [(i, i * 10 + 1, rng.normal(size=8).astype(np.float32)) for i in range(60)]
    c += [(100 + i, 1, c[i][2]) for i in range(5)]  # exact duplicates -> ties broken by key
    c += [(200, 1, np.zeros(8, np.float32))]
    q = [(j, rng.normal(size=8).astype(np.float32)) for j in range(7)]
    qdf, cdf = frames(spark, q, c)
    got = sorted(tuple(r) for r in vector_topk(qdf, cdf, 10, broadcast_bytes=bbytes).collect())
    exp = brute([(i, v.astype(np.float32)) for i, v in q], [(p, v, e.astype(np.float32)) for p, v, e in c], 10)
    assert [g[:4] for g in got] == [e[:4] for e in exp]
    assert all(abs(g[4] - e[4]) < 1e-9 for g, e in zip(got, exp))


def test_k_edges(spark):
    q = [(1, np.ones(4, np.float32))]
    c = [(i, 1, np.full(4, i, np.float32)) for i in range(3)]
    qdf, cdf = frames(spark, q, c)
    assert vector_topk(qdf, cdf, 10).count() == 3          # k capped at corpus size
    assert vector_topk(qdf, cdf, 0).count() == 0           # k <= 0
    assert vector_topk(qdf, cdf.limit(0), 5).count() == 0  # empty corpus


def test_many_query_slices(spark):
    import quaymind.operators.vectors as VX
    rng = np.random.default_rng(11)
    c = [(i, 1, rng.normal(size=8).astype(np.float32)) for i in range(90)]
    q = [(j, rng.normal(size=8).astype(np.float32)) for j in range(17)]
    qdf, cdf = frames(spark, q, c)
    got = sorted(tuple(r) for r in vector_topk(qdf, cdf, 7, broadcast_bytes=8 * 8 * 5).collect())
    exp = brute(q, c, 7)
    assert [g[:4] for g in got] == [e[:4] for e in exp]


@pytest.mark.parametrize("k", [1, 7, 60])
def test_two_phases_give_the_same_rows(spark, k):
    """Also with ties at the k-th score and with shares that hold fewer than k vectors."""
    rng = np.random.default_rng(13)
    c = [(i, 1, np.round(rng.normal(size=4), 1).astype(np.float32)) for i in range(900)]
    q = [(j, np.round(rng.normal(size=4), 1).astype(np.float32)) for j in range(9)]
    qdf, cdf = frames(spark, q, c)
    got = sorted(tuple(r) for r in vector_topk(qdf, cdf, k, bound_bytes=0).collect())
    assert [g[:4] for g in got] == [e[:4] for e in brute(q, c, k)]


def test_candidates_do_not_grow_with_partitions(spark):
    import quaymind.operators.vectors as VX
    rng = np.random.default_rng(17)
    c = [(i, 1, rng.normal(size=8).astype(np.float32)) for i in range(20_000)]
    q = [(j, rng.normal(size=8).astype(np.float32)) for j in range(5)]
    qdf, cdf = frames(spark, q, c)
    asked = qdf.withColumnRenamed("embedding", "_qv").toArrow()
    corpus = cdf.withColumnRenamed("embedding", "_cv")
    keys, k, emitted = ["product_id", "variant_id"], 10, {}
    bounds = VX._lower_bounds(asked, corpus, k, 8, "query_id", keys)
    for parts in (4, 200):
        spread = corpus.repartition(parts)
        emitted[parts] = [VX._broadcast_candidates(asked, spread, k, 8, "query_id", keys, b).count() for b in (None, bounds)]
    assert emitted[200][0] == 5 * k * 200                                  # without bounds: k a query and task
    assert max(emitted[4][1], emitted[200][1]) <= 5 * k * VX.BOUND_STEP * 2
    assert emitted[200][1] < emitted[200][0] / 5


@pytest.mark.parametrize("bbytes", [1 << 20, 0])  # queries broadcast, queries in blocks
@pytest.mark.parametrize("scale", [1.0, 1e19])    # scored in float32 first, in float64 only
def test_near_ties_copies_and_repeated_queries(spark, bbytes, scale):
    """Scores that float32 cannot tell apart, more copies of a vector than k, and a query id that comes twice."""
    rng = np.random.default_rng(23)
    base = rng.normal(size=8).astype(np.float32)
    c = [(i, 1, (base * np.float32(1 + 1e-6 * (i % 7))).astype(np.float32)) for i in range(300)]
    c += [(1000 + i, 2, np.full(8, scale * (i % 5), np.float32)) for i in range(50)]
    q = [(1, base), (2, rng.normal(size=8).astype(np.float32)), (3, -base)]
    qdf, cdf = frames(spark, q, c)
    got = sorted(tuple(r) for r in vector_topk(qdf.unionByName(qdf.where("query_id = 2")), cdf, 20, broadcast_bytes=bbytes).collect())
    exp = brute(q, c, 20)
    twice = sorted(x for r in exp if r[0] == 2 for x in (r, r))[:20]
    want = [r[2:4] for r in exp if r[0] == 1] + [r[2:4] for r in twice] + [r[2:4] for r in exp if r[0] == 3]
    assert [g[2:4] for g in got] == want
    assert [g[1] for g in got] == [*range(1, 21)] * 3


@pytest.mark.parametrize("bbytes", [1 << 20, 0])
def test_non_finite_vectors_take_no_place(spark, bbytes):
    c = [(1, 1, [float("inf"), 1.0]), (2, 1, [float("nan"), 1.0]), (3, 1, [0.5, 0.5]), (4, 1, [0.1, 0.1])]
    qdf, cdf = frames(spark, [(1, [1.0, 1.0]), (2, [float("nan"), 1.0])], c)
    got = [tuple(r)[:3] for r in vector_topk(qdf, cdf.coalesce(1), 1, broadcast_bytes=bbytes).collect()]
    assert got == [(1, 1, 3)]


def test_many_queries_leave_no_candidates_and_do_not_pass_the_driver(spark, monkeypatch):
    """Every task of the block path ranks whole answers: nothing is ranked, broadcast or collected behind it."""
    import quaymind.operators.vectors as VX
    monkeypatch.setattr(VX, "MIN_BLOCK_QUERIES", 10)
    rng = np.random.default_rng(29)
    c = [(i, 1, rng.normal(size=8).astype(np.float32)) for i in range(500)]
    q = [(j, rng.normal(size=8).astype(np.float32)) for j in range(80)]
    qdf, cdf = frames(spark, q, c)
    found = vector_topk(qdf, cdf.repartition(40), 7, broadcast_bytes=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    head = plan[:plan.index("MapInArrow")]
    assert "Window" not in head and "Broadcast" not in plan and plan.count("MapInArrow") == 1
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:4] for g in got] == [e[:4] for e in brute(q, c, 7)]


def test_encoder_matches_token_by_token_counts():
    import pandas as pd
    import xxhash
    from quaymind.operators.vectors import hash_encoder
    texts = ["Almond blue, almond BLUE", "", None, "x"]
    got = hash_encoder(16)(pd.Series(texts))
    for t, v in zip(texts, got):
        toks = (t or "").lower().replace(",", "").split()
        want = np.zeros(16)
        for tok in toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]:
            h = xxhash.xxh64_intdigest(tok)
            want[h % 16] += 1 if (h >> 32) & 1 else -1
        n = np.linalg.norm(want)
        assert np.allclose(v, want / n if n else want) and v.dtype == np.float32


def test_a_large_query_set_shuffles_the_corpus_a_few_times_only(spark):
    """The corpus goes once to every block: 70,000 queries are no more blocks than there are cores."""
    rng = np.random.default_rng(31)
    c = [(i, 1, rng.integers(-9, 10, 2).astype(np.float32)) for i in range(6)]
    qdf = spark.range(70_000).selectExpr("id AS query_id", "array(CAST(id % 13 - 6 AS FLOAT), CAST(id % 7 - 3 AS FLOAT)) AS embedding")
    _, cdf = frames(spark, [], c)
    found = vector_topk(qdf, cdf, 1, broadcast_bytes=0)
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    q = [(i, np.array([i % 13 - 6, i % 7 - 3], np.float32)) for i in range(70_000)]
    assert [tuple(r) for r in found.orderBy("query_id").collect()] == brute(q, c, 1)


def test_answers_leave_a_tile_at_a_time_and_repeated_queries_are_ranked_together(spark, monkeypatch):
    """Ranks are right where the rows of one query id lie in several tiles; a batch holds no more than a tile's answers."""
    import pyarrow as pa
    import quaymind.operators.vectors as VX
    monkeypatch.setattr(VX, "QUERY_TILE", 4)
    monkeypatch.setattr(VX, "CORPUS_BATCH_ROWS", 16)
    rng = np.random.default_rng(37)
    c = [(i, i % 3, rng.integers(-4, 5, 6).astype(np.float32)) for i in range(120)]
    ids = np.array([5, 1, 5, 2, 5, 5, 9, 5, 5, 5, 3, 5, 5, 9, 1, 7])
    q = [(int(i), rng.integers(-4, 5, 6).astype(np.float32)) for i in ids]
    k = 5
    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "rank", "a", "b")] + [("score", pa.float64())])
    cell = pa.table({"_side": [0] * len(q) + [1] * len(c), "_k0": [i for i, _ in q] + [x[0] for x in c],
                     "_k1": [0] * len(q) + [x[1] for x in c],
                     "_v": pa.array([v.tolist() for _, v in q] + [x[2].tolist() for x in c], pa.list_(pa.float32()))})
    out = list(VX._arrow_cell_fn(k, 6, 2, True, schema)(iter(cell.to_batches(max_chunksize=10))))
    assert max(b.num_rows for b in out) <= 4 * k
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = []
    for i in sorted(set(ids.tolist())):
        found = [r for j, v in q if j == i for r in brute([(i, v)], c, k)]
        found.sort(key=lambda r: (-r[4], r[2], r[3]))
        want += [(i, n + 1, *r[2:]) for n, r in enumerate(found[:k])]
    assert sorted(got) == want
