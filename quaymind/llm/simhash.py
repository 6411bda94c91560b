"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed once per text in Arrow batches.  The distinct ones
form a binary trie over their bits; the self-join walks pairs of trie nodes
from the top, adds the differing bit when it descends into unlike children,
and drops a pair as soon as it differs in more than ``max_bits`` bits.

The upper levels of that walk are Spark's: a node's fingerprints are sent, for
each partner node still within the budget, to the task of that node pair
(``expand`` walks the next ``STEP_BITS`` levels and prunes).  Node pairs that
are still too large are expanded again, so a crowded branch is split as deep
as it needs.  The lower levels run inside the task on sorted arrays, again
from node pair to node pair.  A task returns a spanning star forest of its
links, never the pairs themselves.  Components then come from large-star /
small-star rounds on that forest.

Defined cases: a null or wordless text has fingerprint 0, linked like any
other; an empty table gives no rows; repeated rows share a fingerprint; a
component's id is its smallest non-null doc_id (null if it has none); very
long texts are hashed whole, in bounded pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymind.llm.common import BROADCAST_BYTES, DOC_COLUMNS, bound_arrow_batches, materialize, project
from quaymind.session import ship_package

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Trie levels that one Spark step descends.
STEP_BITS = 4
#: A task takes node pairs of at most about this many fingerprints.
NODE_ROWS = 20_000
#: Hashes counted at once: bounds the memory a very long text takes.
PIECE = 1 << 15
#: Node pairs up to this many comparisons are compared directly.
LEAF = 64


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    total, ones = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64)
    while True:
        piece = np.fromiter((digest(g, SEED) for g in islice(grams, PIECE)), dtype=np.uint64)
        if not len(piece):
            break
        bits = np.unpackbits(piece.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(prints.view(np.int64))],
                                             names=[*kept, "fp"])
    return run


def with_fingerprints(df: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``df`` without text, and ``fp`` (the 64 bits as a signed long)."""
    ship_package(df.sparkSession)
    bound_arrow_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != "text"] + [T.StructField("fp", T.LongType())])
    return df.mapInArrow(_fingerprint_batches(shingle), schema)


# ---------------------------------------------------------------- the walk inside one task

def walk(a: np.ndarray, b: np.ndarray, used_bits: int, spent: int, max_bits: int):
    """Index pairs (i, j) with at most ``max_bits`` differing bits.

    ``a`` and ``b`` are sorted; all of ``a`` (and all of ``b``) share their
    upper ``used_bits`` bits, which differ in ``spent`` places.  Yields arrays.
    """
    top = 63 - used_bits
    stack = [(np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([spent]), top)]
    while stack:
        alo, ahi, blo, bhi, diff, bit = stack.pop()
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (bit < 0)
        if small.any():
            rows, cols = (ahi - alo)[small], (bhi - blo)[small]
            n = rows * cols
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = alo[small][which] + k // cols[which]
            j = blo[small][which] + k % cols[which]
            near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if near.any():
                yield i[near], j[near]
        alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        one = np.uint64(1) << np.uint64(bit)
        high = ~np.uint64((int(one) << 1) - 1)
        amid = np.clip(np.searchsorted(a, (a[alo] & high) | one), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & high) | one), blo, bhi)
        kids = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff),
                (alo, amid, bmid, bhi, diff + 1), (amid, ahi, blo, bmid, diff + 1)]
        merged = [np.concatenate(x) for x in zip(*kids)]
        alive = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= max_bits)
        merged = [x[alive] for x in merged]
        for at in range(0, len(merged[0]), 1 << 15):
            stack.append((*[x[at:at + (1 << 15)] for x in merged], bit - 1))


def _stars(size: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Merge links into ``root`` (each item's smallest linked index, fully compressed)."""
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            return root
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def _pair_links(max_bits: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        used, spent = int(frame["used"].iloc[0]), int(frame["spent"].iloc[0])
        side = frame["side"].to_numpy()
        fps = frame["fp"].to_numpy().view(np.uint64)
        a, b = np.sort(fps[side <= 0]), np.sort(fps[side >= 0])
        items = np.unique(np.concatenate([a, b]))
        ia, ib = np.searchsorted(items, a), np.searchsorted(items, b)
        root = np.arange(len(items))
        for i, j in walk(a, b, used, spent, max_bits):
            root = _stars(len(items), ia[i], ib[j], root)
        moved = np.flatnonzero(root != np.arange(len(items)))
        return pd.DataFrame({"u": items[moved].view(np.int64), "v": items[root[moved]].view(np.int64)})
    return run


# ---------------------------------------------------------------- the walk between tasks

def _expand(pairs: DataFrame, max_bits: int) -> DataFrame:
    """Descend ``STEP_BITS`` levels: each fingerprint goes to every partner child within the budget.

    A row is (na, nb, used, spent, side, fp): node pair by the upper ``used``
    bits of each, na <= nb; side -1 is na's, 1 is nb's, 0 both (na = nb).
    """
    kids = 1 << STEP_BITS
    shift = 64 - STEP_BITS
    # the child's number: the STEP_BITS bits of fp below the used ones
    child = F.expr(f"shiftrightunsigned(shiftleft(fp, used), {shift})")
    masks = F.expr("array(" + ",".join(f"{m}L" for m in sorted(range(kids), key=lambda m: (m.bit_count(), m))
                                       if m.bit_count() <= max_bits) + ")")
    out = (pairs.withColumn("child", child).withColumn("mask", F.explode(masks))
           .withColumn("total", F.col("spent") + F.bit_count("mask")).where(F.col("total") <= max_bits))
    own, other = F.col("child"), F.col("child").bitwiseXOR(F.col("mask"))
    base = lambda n: F.shiftleft(F.col(n), STEP_BITS)
    # within one node, a fingerprint is on the side that its child's order gives it
    low = F.when(F.col("side") != 0, F.col("side") < 0).otherwise(own < other)
    side = F.when((F.col("side") == 0) & (F.col("mask") == 0), 0).when(low, -1).otherwise(1)
    na = F.when(low, base("na").bitwiseOR(own)).otherwise(base("na").bitwiseOR(other))
    nb = F.when(low, base("nb").bitwiseOR(other)).otherwise(base("nb").bitwiseOR(own))
    return out.select(na.alias("na"), nb.alias("nb"), (F.col("used") + STEP_BITS).alias("used"),
                      F.col("total").cast("int").alias("spent"), side.alias("side"), "fp")


def link_forest(prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints whose components are those of all links."""
    total = prints.count()
    key = ["na", "nb", "used"]
    level = prints.select(F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), F.lit(0).alias("used"),
                          F.lit(0).alias("spent"), F.lit(0).alias("side"), "fp")
    found = []
    rows = total
    for depth in range(0, 64, STEP_BITS):
        if rows <= node_rows:
            break
        level = materialize(_expand(level, max_bits), "trie-level")
        # the two sides of every pair; one side alone can't link
        sizes = (level.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
                 .where((F.col("lo") == 0) | (F.col("lo") < F.col("hi"))))
        sizes = materialize(sizes, "trie-nodes")
        rows = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if rows <= node_rows:
            break
        large = sizes.where(F.col("n") > node_rows).select(*key)
        done = level.join(sizes.where(F.col("n") <= node_rows).select(*key), key, "left_semi")
        found.append(done)
        level = level.join(large, key, "left_semi")
    found.append(level)
    schema = "u long, v long"
    links = [x.groupBy(*key).applyInPandas(_pair_links(max_bits), schema) for x in found]
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- components

def _lowest_neighbour(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every node on an edge (u, v): root is its component's smallest node.

    Alternates large-star and small-star rounds; each uses partial minima and
    one equi-join, never a node's neighbours in one place.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour v of u is linked to u's smallest neighbour
        low = _lowest_neighbour(edges).withColumnRenamed("u", "w")
        large = (edges.join(low, edges["v"] == low["w"]).select(F.col("u"), F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u")
        small = (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = materialize(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classes(prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """fp, component_id and root, the class's smallest fingerprint, for a table of (doc_id, fp) rows."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    links = link_forest(nodes.select("fp"), max_bits, node_rows)
    roots = components(links)
    named = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = materialize(named.join(ids, "root").select("fp", "component_id", "root"), "classes")
    return moved


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fp (long) and component_id of every document."""
    rows = project(docs, {"doc_id": "bigint", "text": "string"})
    slim = materialize(with_fingerprints(rows, shingle), "simhash")
    return slim.join(classes(slim, max_bits, node_rows).drop("root"), "fp")


def op5_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame) -> DataFrame:
    """One document of every near-duplicate class: the one with the smallest id (a null id last).

    A class is known by its root fingerprint, as ids may repeat or be null.
    Documents with the same id and class are told apart by a row number that
    is written down with the texts, so exactly one stays.
    """
    rows = materialize(project(docs, DOC_COLUMNS).withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
    slim = materialize(with_fingerprints(rows.select("row", "doc_id", "text")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    # one candidate per fingerprint, then one per class
    per_print = slim.groupBy("fp").agg(first.alias("first"))
    chosen = (per_print.join(classes(slim), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")))
    chosen = materialize(chosen, "simhash-kept")
    kept = F.broadcast(chosen) if chosen.count() * 16 <= BROADCAST_BYTES // 8 else chosen
    return rows.join(kept, "row", "left_semi").select(*DOC_COLUMNS)
