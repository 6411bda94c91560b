"""Orchard search and the codebooks against plain nearest entries."""

import hashlib
import math

import numpy as np
import pytest

from quaymind.llm import codes


def _plain_nearest(entries, parts):
    d = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread,count,width", [(3, 256, 4), (500, 256, 16), (500, 7, 2), (1, 256, 1), (10**6, 1, 3)])
def test_nearest_entries_and_ties(spread, count, width):
    rng = np.random.default_rng(spread + count)
    entries = rng.integers(-spread, spread + 1, (count, width))
    parts = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (6_000, width)), entries])
    book = codes.Orchard(entries)
    at, near = book.nearest(parts)
    want_at, want_near = _plain_nearest(entries, parts)
    assert (at == want_at).all() and (near == want_near).all()


def test_search_compares_few_entries_of_clustered_books():
    rng = np.random.default_rng(1)
    entries = (rng.integers(0, 40, (256, 2)) * 1_000)
    parts = entries[rng.integers(0, 256, 5_000)] + rng.integers(-30, 31, (5_000, 2))
    book = codes.Orchard(entries)
    book.nearest(parts)
    assert book.compared < 0.5 * 256 * len(parts)


def _plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    x = np.array([[math.floor(1024 * c) for c in v] + [0] * (parts * width - len(v)) for _, _, v in kept])
    x = x.reshape(len(kept), parts, width)
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, x[n].reshape(-1).tolist()))
    books = [x[order[:entries], p].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            at, _ = _plain_nearest(books[p], x[:, p])
            for e in set(at.tolist()):
                books[p][e] = x[at == e, p].sum(axis=0) // (at == e).sum()
    found = [_plain_nearest(books[p], x[:, p]) for p in range(parts)]
    error = sum(near for _, near in found)
    by_label = {}
    for (_, label, _), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{at[n]:02x}" for at, _ in found), int(error[n]), by_label[label], digest)
                  for n, (i, label, _) in enumerate(kept))


def _rows(count, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dim).astype(np.float32).astype(float).tolist(), int(i % 3)) for i in range(count)]
    rows = [(i, v, None if i % 7 == 0 else label) for i, v, label in rows]
    return rows + [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], 2), (900, None, 1), (901, [0.5] * (dim - 1) + [None], 1),
                   (902, [float("nan")] * dim, 1), (903, [float("inf")] + [0.0] * (dim - 1), 1)]


@pytest.mark.parametrize("count,dim", [(600, 16), (40, 8), (300, 6)])
def test_codes_match_plain_rounds(spark, count, dim):
    """Also fewer vectors than entries, a length that four does not divide, and shorter vectors."""
    rows = _rows(count, dim, count) + ([(950, [0.25, -0.5], 0), (951, [], 0)] if dim == 6 else [])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
                 for r in codes.op13_codes(df).collect())
    assert got == _plain(rows)


def test_huge_components_and_empty_table(spark):
    rows = [(i, [float(10**i), -1e300, 0.0, 1.0], 0) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert codes.op13_codes(df).count() == 12
    assert codes.op13_codes(df.limit(0)).collect() == []
