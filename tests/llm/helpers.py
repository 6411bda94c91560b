"""Small tables and plain Python versions that the operators are held against."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    """A documents table with two extra columns, one of which differs from ``text`` by case only."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, "en", sources[i] if sources else "s", None if t is None else len(t), "x", 1))
    return spark.createDataFrame(rows, DOC_SCHEMA + ", TEXT_2 string, size int") \
        .withColumnRenamed("TEXT_2", "TEXT")


def spans_text(found):
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def classes(items, linked):
    """Smallest reachable item of every item, by plain union-find over all pairs."""
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(items):
        for b in items[n + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}
