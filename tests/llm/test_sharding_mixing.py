"""Sharding and mixing against plain sorting and prefix sums."""

import hashlib
import math
import zlib

import pytest
from helpers import WORD, documents

from quaymind.llm import mixing, sharding


def expected_shards(rows, shards=8):
    order = sorted((zlib.crc32((t or "").encode()), d is not None, d or 0, len((t or "").encode()) + 1) for d, t in rows)
    total, offset, slots, out = sum(r[3] for r in order), 0, [0] * shards, []
    for crc, known, d, size in order:
        shard = (2 * offset + size) * shards // (2 * total)
        out.append((d if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        offset += size
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=repr)


TEXTS = [None, "", "é" * 50] + ["copy of one text"] * 120 + [f"text {i} " * (1 + i % 40) for i in range(200)] + ["x" * 3000]


def test_shards_are_the_equal_cuts_of_the_order(spark):
    df = documents(spark, TEXTS)
    assert got(sharding.op1_sharding(df)) == expected_shards(list(enumerate(TEXTS)))


def test_null_ids_and_repeated_rows_get_slots_of_their_own(spark):
    texts = ["same"] * 90 + [f"t{i}" for i in range(30)]
    ids = [None] * 40 + [7] * 50 + list(range(30))
    df = documents(spark, texts, ids=ids)
    rows = sharding.op1_sharding(df).collect()
    assert got(sharding.op1_sharding(df)) == expected_shards(list(zip(ids, texts)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_overfull_ranges_are_subdivided_without_changing_the_result(spark):
    # one text holds most rows: the first splitters can't cut it by its CRC alone
    texts = ["hot"] * 400 + [f"cold {i}" for i in range(100)]
    df = documents(spark, texts)
    assert got(sharding.shard_documents(df, rows_per_range=5)) == expected_shards(list(enumerate(texts)))


def test_written_shards_hold_every_document_once(spark, tmp_path):
    df = documents(spark, TEXTS)
    sharding.write_shards(df, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in back.collect()) == list(range(len(TEXTS)))


def plain_mix(rows, weights=(5, 2, 1), most=3, seed=20):
    """rows: (doc_id, source, size) -> sorted (doc_id, size, source_size, target, taken)"""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in fixed)
        if not rest:
            break
        share = (total - sum(most * sizes[s] for s in fixed)) / rest
        over = {s for s in names if s not in fixed and weight[s] * share > most * sizes[s]}
        if not over:
            break
        fixed |= over
    target = {s: float(most * sizes[s]) if s in fixed else weight[s] * share for s in names}
    out = []
    for s in names:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        name = "n" if s is None else "s" + s
        u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:5], 16) / (1 << 20)
        own = [r for r in rows if r[1] == s]
        own.sort(key=lambda r: (r[2], hashlib.md5((f"{seed}" + ("" if r[0] is None else f":{r[0]}")).encode()).hexdigest(),
                                r[0] is not None, r[0] or 0))
        for i, (d, _, n) in enumerate(own):
            copies = min(most, math.floor((i + 1) * rate + u) - math.floor(i * rate + u))
            out.append((d, n, sizes[s], round(target[s], 6), n * copies))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def mixed():
    texts = [None, "", " \t "] + [("w " * (1 + (7 * i) % 23)).strip() for i in range(300)]
    sources = [["a", "b", None, "zz", "é"][(i * i) % 5] for i in range(len(texts))]
    return texts, sources


def test_mix_matches_prefix_sums(spark, mixed):
    texts, sources = mixed
    df = mixing.op8_mixing(documents(spark, texts, sources))
    rows = [(i, s, len(WORD.findall(t or ""))) for i, (t, s) in enumerate(zip(texts, sources))]
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr) \
        == plain_mix(rows)


def test_taken_words_come_near_the_targets(spark, mixed):
    texts, sources = mixed
    rows = mixing.op8_mixing(documents(spark, texts, sources)).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own) + 1


def test_mixed_documents_are_written_as_often_as_taken(spark, mixed):
    texts, sources = mixed
    df = documents(spark, texts, sources)
    # documents without words have size 0 and take nothing, however often they are drawn
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.mixed_documents(df).collect())
    assert words == sum(r.taken for r in mixing.op8_mixing(df).collect())


def test_one_source_without_words(spark):
    rows = mixing.op8_mixing(documents(spark, [None, ""], ["a", "b"])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 2
