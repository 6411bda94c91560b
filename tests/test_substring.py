"""Gram index joins (J4, P3) against plain substring and word-boundary tests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quaymind.operators import classify as CL
from quaymind.operators import match as M
from quaymind.operators.substring import substring_pairs


def _words(rng, n, alphabet="abcdé ñ😀.x"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_pairs_match_plain_contains(spark):
    rng = random.Random(4)
    texts = _words(rng, 300) + ["", "a\nb\nc", None]
    needles = sorted({t[i:i + n] for t in texts[:200] if t for i in (0, 2) for n in (0, 1, 2, 3, 5)}) + ["zz", "zzzz", "b\nc"]
    got = {tuple(r) for r in substring_pairs(spark.createDataFrame(list(enumerate(texts)), "tid int, text string"),
                                             spark.createDataFrame([(n,) for n in needles + needles[:5] + [None]], "needle string")).collect()}
    assert got == {(n, i) for n in needles for i, t in enumerate(texts) if t is not None and n in t}


def test_pairs_with_no_needles_or_texts(spark):
    texts = spark.createDataFrame([(1, "a")], "tid int, text string")
    none = spark.createDataFrame([], "needle string")
    assert substring_pairs(texts, none).collect() == []
    assert substring_pairs(texts.limit(0), spark.createDataFrame([("a",)], "needle string")).collect() == []


def test_large_sides_give_the_pairs_of_small_ones(spark, monkeypatch):
    """Beyond the limit of pairs the index gives the same stores, and no nested loop is planned."""
    rng = random.Random(8)
    names = _words(rng, 80, "Abc Dé")
    stores = spark.createDataFrame([(i, n, names[-i] if i % 3 else None) for i, n in enumerate(names)], "id int, name string, location string")
    dictionary = spark.createDataFrame([(t, t[:k]) for t in names[:40] for k in (1, 3, 9)] + [("all", ""), ("kl", "C D")], "term string, needle string")
    messages = spark.createDataFrame([(i, t) for i, t in enumerate(names[:60] + ["unknown", "all", "kl", None])], "m int, location_term string")
    want = sorted(map(tuple, M.match_stores(messages, dictionary, stores).collect()))
    monkeypatch.setattr(M, "OUTRIGHT_PAIRS", 0)
    out = M.match_stores(messages, dictionary, stores)
    assert sorted(map(tuple, out.collect())) == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["store_id"] for r in out.where("location_term = 'all'").collect()} == set(range(80))


def test_locations_match_plain_word_boundaries(spark):
    rng = random.Random(2)
    terms = ["new york", "york", "new", "kota-x", "kota", "x", "c++", "++", "!!", "é", "São paulo", "são paulo", "a b c", "\\E.", "."]
    pool = ["new", "york", "kota-x", "kota", "x", "c++", "++", "!!", "é", "éa", "São", "Paulo", "a", "b", "c", "\\E.", "newyork", ".", "_x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 7))) for _ in range(200)] + ["", None, "a!!b", "x!!", "NEW york"]
    texts += texts[:20]

    def plain(text):
        if text is None:
            return None
        found = [(-len(t), i, t) for i, t in enumerate(terms)
                 if re.search(CL.location_pattern(t).replace(r"[\p{L}\p{N}_]", r"\w"), text.lower())]
        return min(found)[2] if found else None
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, t string, _word string").repartition(3)
    d = spark.createDataFrame([(t, i) for i, t in enumerate(terms)] + [("york", 99)], "term string, ordinal int")
    got = CL.detect_location(df, "t", d, out="loc")
    assert got.columns == ["id", "t", "_word", "loc"]
    assert {r["id"]: r["loc"] for r in got.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert CL.detect_location(df, "t", d.limit(0), out="loc").where(F.col("loc").isNotNull()).count() == 0


@pytest.mark.parametrize("text", [None, "", "nothing here"])
def test_no_location(spark, text):
    d = spark.createDataFrame([("kl", 1), ("!!", 2)], "term string, ordinal int")
    assert CL.detect_location(spark.createDataFrame([(text,)], "t string"), "t", d).collect()[0]["location_term"] is None
