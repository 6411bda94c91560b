"""What a worker remembers is bounded, and changes no ids."""

import random

import numpy as np

from quaymind.llm import bpe


def test_a_used_entry_outlives_a_full_generation():
    recent = bpe.Recent(10 * (bpe.ENTRY_BYTES + 8))
    recent.put("kept", "1")
    for i in range(200):
        recent.put(f"k{i:03d}", "1,2")
        assert recent.get("kept") == "1"
        assert len(recent.young) + len(recent.old) <= 22
    assert recent.get("k000") is None and recent.get("k199") == "1,2"


def test_a_small_cache_gives_the_same_ids():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé ñ\n中😀'1.") for _ in range(rng.randint(1, 9))) for _ in range(3_000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", " ".join(words)]
    ranks, pattern = bpe.read_ranks(bpe.vocabulary()), bpe._split_pattern()
    small, large = bpe.Codec(ranks, pattern, 2_000), bpe.Codec(ranks, pattern)
    for some in (texts[:20], texts[20:], texts[:20]):
        for (a, x), (b, y) in zip(small.encode_batch(some), large.encode_batch(some)):
            assert np.array_equal(a, b) and x == y == ",".join(map(str, a))
    assert sum(len(c.young) + len(c.old) for c in (small.cache, small.pieces)) < 40
