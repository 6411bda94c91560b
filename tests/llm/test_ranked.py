"""The Best Position Algorithm against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quaymind.llm import ranked
from tests.llm.helpers import documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _plain(texts, items, k=10):
    terms = [TERM.findall((t or "").translate(LOWER)) for t in texts]
    held = [Counter(t) for t in terms]
    n_docs, length = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(t for h in held for t in h)
    out = set()
    for item, text in items:
        hits = []
        for doc, (all_terms, h) in enumerate(zip(terms, held)):
            m = 10 + 90 * len(all_terms) * n_docs // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * h[t] // (1000 * h[t] + 8 * m))
                        for t in dict.fromkeys(TERM.findall((text or "").translate(LOWER))) if t in h)
            if score > 0:
                hits.append((-score, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(hits)[:k])}
    return out


def _corpus(rng, docs):
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ÉTÉ", "x_y", "a-b", "C3PO"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(docs)]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_matches_scores_of_all_documents(spark, monkeypatch, block):
    """Also with many small blocks, copies (ties), one very long text, nulls and empty texts."""
    rng = random.Random(11)
    texts = _corpus(rng, 400)
    texts += [texts[0]] * 30 + [None, "", "...", " ".join(rng.choices(["w1", "w2", "rare"], k=200_000))]
    items = [(i, " ".join(rng.sample(texts[i], min(1, len(texts[i]))) + [texts[i], "rare"])) for i in range(12)]
    items += [(90, ""), (91, None), (92, "nowhere"), (93, "w0")]
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", block)
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = {tuple(r) for r in ranked.search(documents(spark, texts), bench).collect()}
    assert got == _plain(texts, items)
    # the same in many blocks of queries
    assert {tuple(r) for r in ranked.search(documents(spark, texts), bench, item_bytes=200).collect()} == got


def test_no_document_holds_a_term(spark):
    bench = spark.createDataFrame([(1, "zzz")], "item_id long, text string")
    assert ranked.search(documents(spark, ["a", None, ""]), bench).collect() == []
    assert ranked.search(documents(spark, ["a"]), bench.limit(0)).collect() == []


def _lists(impact_by_term, docs):
    rows = sorted((d, t, s) for t, hits in impact_by_term.items() for d, s in hits.items())
    doc, term, impact = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    return ranked.ImpactLists(doc, term, impact, docs)


@pytest.mark.parametrize("seed", range(5))
def test_search_is_exact_with_a_known_bound(seed):
    rng = random.Random(seed)
    lists = {t: {d: rng.randint(1, 50) for d in rng.sample(range(500), rng.randint(1, 500))} for t in range(6)}
    index = _lists(lists, 500)
    total = Counter()
    for hits in lists.values():
        total.update(hits)
    best = sorted(((-s, d) for d, s in total.items()))[:10]
    for known in (0, -best[9][0], -best[3][0]):
        doc, score = index.search(list(range(6)), 10, known)
        found = dict(zip(doc.tolist(), score.tolist()))
        assert all(found[d] == -s for s, d in best if -s >= known)


def test_stops_before_the_ends_of_the_lists(monkeypatch):
    """Direct accesses mark positions, so the best positions pass the last ones read in sorted order."""
    docs = 20_000
    high = {d: 10_000 - d for d in range(docs // 2)}
    index = _lists({0: high, 1: {d: 10_000 - d // 2 for d in range(docs // 2)}, 2: {docs - 1: 5}}, docs)
    looked = []
    real = np.searchsorted
    monkeypatch.setattr(ranked.np, "searchsorted", lambda a, v: looked.append(len(v)) or real(a, v))
    doc, score = index.search([0, 1, 2], 5, 0)
    order = np.lexsort((doc, -score))[:5]
    assert doc[order].tolist() == [0, 1, 2, 3, 4]
    assert sum(looked) < 3 * docs / 50
