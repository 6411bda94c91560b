"""Consistent weighted samples against a plain version of the same draws."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash

from quaymind.llm import fingerprints as fp
from tests.llm.helpers import WORD, documents


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash_long(value, seed=42):
    return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


def _draws(h, word):
    term = _signed(xxhash.xxh64_intdigest(word.encode(), 42))
    x1 = _hash_long(term, xxhash.xxh64_intdigest(h.to_bytes(4, "little"), 42))
    x2 = _hash_long(x1)
    low, high = [((x1 >> s & (1 << 21) - 1) + 0.5) / 2**21 for s in (0, 21)]
    b = ((x1 >> 42 & (1 << 21) - 1) + 0.5) / 2**21
    q = ((x2 >> 32) + 0.5) / 2**32 * (((x2 & (1 << 32) - 1) + 0.5) / 2**32)
    return -math.log(low * high), math.log(-math.log(q)), b


def _plain(text, samples):
    """Every term's score, without the bound; the smallest of each sample."""
    weights = Counter(WORD.findall((text or "").lower()))
    found = []
    for h in range(samples):
        scores = []
        for word, n in weights.items():
            r, c, b = _draws(h, word)
            scores.append(c - r * (math.floor(math.log(n) / r + b) - b + 1.0))
        found.append(min(scores, default=None))
    return found


def _edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for at, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        q = len(text) // 4
        out[doc_id] = (text, text[:len(text) - q] + after[:q], after)
    return out


def _texts():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(pool[:rng.choice((20, 400))]) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    return texts + [None, "", "one", "one", "Ünï çödé\tone\n", " \n ", "a " * 5_000, texts[0]]


def test_samples_match_plain_draws(spark):
    texts = _texts()
    found = {r["doc_id"]: r for r in fp.op11_fingerprints(documents(spark, texts)).collect()}
    assert sorted(found) == list(range(len(texts)))
    scores = {}

    def likeness(a, b):
        for t in (a, b):
            scores.setdefault(t, _plain(t, fp.SAMPLES))
        return sum(x == y for x, y in zip(scores[a], scores[b])) / fp.SAMPLES
    for doc_id, (text, edited, after) in _edited(list(enumerate(texts))).items():
        row = found[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row["fingerprint"]) == len(row["edited_fingerprint"]) == fp.SAMPLES * fp.DIGITS
        assert row["near_edited"] == pytest.approx(likeness(text, edited), abs=1.01 / fp.SAMPLES)
        assert row["near_next"] == pytest.approx(likeness(text, after), abs=1.01 / fp.SAMPLES)
    by_text = {}
    for doc_id, text in enumerate(texts):
        by_text.setdefault(text or "", set()).add(found[doc_id]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert by_text[""] == {"0" * fp.SAMPLES * fp.DIGITS}


@pytest.mark.parametrize("prune", [0.5, 3.0])
def test_open_samples_are_drawn_again(spark, prune):
    """A bound that leaves many samples open changes nothing."""
    df = documents(spark, _texts())
    want = {r["doc_id"]: tuple(r) for r in fp.op11_fingerprints(df).collect()}
    assert {r["doc_id"]: tuple(r) for r in fp.op11_fingerprints(df, prune=prune).collect()} == want


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(5)
    weights = [{f"t{i}": rng.randint(1, 9) for i in rng.sample(range(60), 40)} for _ in range(12)]
    df = spark.createDataFrame([(n, " ".join(w for w, k in x.items() for _ in range(k))) for n, x in enumerate(weights)],
                               "id long, text string")
    marks = {r["id"]: r["fingerprint_text"] for r in fp.fingerprints(df, "id", ["text"], samples=512).collect()}
    errors = []
    for a in range(12):
        for b in range(a):
            both = set(weights[a]) | set(weights[b])
            pairs = [(weights[a].get(t, 0), weights[b].get(t, 0)) for t in both]
            want = sum(map(min, pairs)) / sum(map(max, pairs))
            got = sum(marks[a][i:i + 4] == marks[b][i:i + 4] for i in range(0, 4 * 512, 4)) / 512
            errors.append(got - want)
            assert abs(got - want) < 5 * math.sqrt(want * (1 - want) / 512) + 0.01
    assert abs(sum(errors) / len(errors)) < 0.02


def test_repeated_rows_and_ids(spark):
    df = documents(spark, ["x y z w", "x y z w", "other text here", "x y"], ids=[1, 1, 1, None])
    rows = fp.op11_fingerprints(df).collect()
    assert len(rows) == 4
    same = [tuple(r) for r in rows if r["n_chars"] == 7]
    assert len(same) == 2 and same[0] == same[1]
    alone = fp.op11_fingerprints(documents(spark, ["a b c d e f g h"])).first()
    assert alone["near_next"] == 1.0
