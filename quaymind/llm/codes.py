"""Vector code compression: product codes whose nearest entries are found by Orchard search.

Components become integers floor(1024 * x); a vector is cut into equal parts
and each part is replaced by the number of the nearest entry of its part's
codebook.  Codebooks start as the parts of the vectors with the smallest ids
and are refined in rounds: assign all parts, then move every used entry to the
floored mean of its parts.

Nearest entries come from Orchard's search.  Every entry has a list of all
entries of its codebook by distance from it.  A part starts at one entry and
goes down that entry's list; a nearer entry (or an equally near one with a
lower number) becomes the current one and the search jumps to its list;
entries compared once are marked and not compared again; the search stops
where the list is more than twice the current distance away, since by the
triangle inequality nothing further down can be as near.  All distances are
squared integers, so stops and ties are exact.  Many parts take their steps
together as array rows.

The vectors are written once as integers.  Every round is one pass over them:
a task sends one partial sum per codebook component, Spark adds them up, and
only the new codebooks (a fixed size) reach the driver.

Defined cases: vectors that are null or hold null or non-finite components
take no part; an empty vector has empty parts, all at entry 0; shorter vectors
count as padded with zeros to the longest, and the longest to a multiple of
the number of parts; components are cut to the largest range in which
four times a squared distance is still a long; rows with a null id come last among the
smallest ids and are encoded too; rows with one id are all encoded and, as
candidates for the codebook, ordered by their components; with fewer vectors
than entries the codebooks are as much smaller; null labels are one label; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymind.llm.common import materialize, project
from quaymind.session import ship_package

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows whose searches step together.
STEP_ROWS = 4_096
#: Label sums are broadcast up to this many labels.
BROADCAST_LABELS = 100_000


class Orchard:
    """Nearest entries of one codebook (integers, one entry a row)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.compared = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of every part, ties to the lower, and the squared distance."""
        found = [self._walk(parts[s:s + STEP_ROWS]) for s in range(0, len(parts), STEP_ROWS)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _walk(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, count = len(parts), len(self.entries)
        at = np.zeros(rows, dtype=np.int64)                     # the current entry
        near = ((parts - self.entries[0]) ** 2).sum(axis=1)     # its squared distance
        down = np.zeros(rows, dtype=np.int64)                   # the place in its list
        marked = np.zeros((rows, count), dtype=bool)
        marked[:, 0] = True
        self.compared += rows
        active = np.arange(rows)
        while len(active):
            entry, place = at[active], down[active]
            # beyond twice the distance: |c x| > 2 |q c|, squared
            on = self.apart[entry, place] <= 4 * near[active]
            active, entry, place = active[on], entry[on], place[on]
            other = self.order[entry, place]
            down[active] += 1
            fresh = ~marked[active, other]
            who, which = active[fresh], other[fresh]
            if len(who):
                self.compared += len(who)
                marked[who, which] = True
                distance = ((parts[who] - self.entries[which]) ** 2).sum(axis=1)
                closer = (distance < near[who]) | ((distance == near[who]) & (which < at[who]))
                jump = who[closer]
                at[jump], near[jump], down[jump] = which[closer], distance[closer], 0
            active = active[down[active] < count]
        return at, near


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (as text) and the scaled components of the vectors that take part."""
    rows = project(df, {id_col: "bigint", vector_col: "array<double>", label_col: "string"}).toDF("vec_id", "raw", "label")
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # the cut to a long is far beyond the range that is kept later
    whole = F.transform("raw", lambda x: F.floor(F.greatest(F.least(x * float(SCALE), F.lit(2.0**62)), F.lit(-2.0**62))))
    return rows.where(F.col("raw").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.Array, parts: int, width: int, limit: int) -> np.ndarray:
    """The vectors as rows x parts x width, padded and cut to the range."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), parts * width), dtype=np.int64)
    out[np.arange(parts * width)[None, :] < sizes[:, None]] = flat
    return np.clip(out, -limit, limit).reshape(len(sizes), parts, width)


def _partial_sums(shared, width: int, limit: int):
    """Per part, entry and component: the sum and number of the task's parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Orchard(b) for b in shared.value]
        sums = np.zeros((len(books), len(books[0].entries), width), dtype=np.int64)
        uses = np.zeros(sums.shape[:2], dtype=np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), len(books), width, limit)
            for p, book in enumerate(books):
                at, _ = book.nearest(v[:, p])
                np.add.at(sums[p], at, v[:, p])
                uses[p] += np.bincount(at, minlength=len(book.entries))
        part, entry = np.nonzero(uses)
        ends = np.arange(len(part) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(uses[part, entry]),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[part, entry].reshape(-1)))],
            names=["part", "entry", "uses", "sums"])
    return run


def _encoded(shared, width: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Orchard(b) for b in shared.value]
        for batch in batches:
            v = _matrix(batch.column("v"), len(books), width, limit)
            found = [book.nearest(v[:, p]) for p, book in enumerate(books)]
            code = np.stack([at for at, _ in found], axis=1)
            error = np.sum([near for _, near in found], axis=0).astype(np.int64)
            text = ["".join(f"{e:02x}" for e in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"])
    return run


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """The codebooks (part x entry x component), and the width of a part and the range of a component."""
    sc = vectors.sparkSession.sparkContext
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    limit = (math.isqrt((1 << 60) // (width * parts)) - 1) // 2
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = _matrix(first.column("v").combine_chunks(), parts, width, limit).swapaxes(0, 1).copy()
    for _ in range(rounds):
        shared = sc.broadcast(books)
        sums = vectors.select("v").mapInArrow(_partial_sums(shared, width, limit),
                                              "part int, entry int, uses long, sums array<long>")
        added = sums.select("part", "entry", "uses", F.posexplode("sums").alias("place", "x")).groupBy(
            "part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("uses").alias("uses")).collect()
        shared.destroy()
        books = books.copy()
        for r in added:
            books[r["part"], r["entry"], r["place"]] = r["x"] // r["uses"]
    return books, width, limit


def product_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
                  vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error and the digest of the codebooks of every vector that takes part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = df.sparkSession
    ship_package(spark)
    vectors = materialize(quantized(df, id_col, vector_col, label_col), "integer-vectors")
    schema = "vec_id long, label string, code string, error long"
    if not vectors.limit(1).count():
        return spark.createDataFrame([], schema + ", codebooks_sha256 string")
    books, width, limit = fit_codebooks(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)
    return vectors.mapInArrow(_encoded(shared, width, limit), schema).withColumn("codebooks_sha256", F.lit(digest))


def op13_codes(embeddings: DataFrame) -> DataFrame:
    coded = materialize(product_codes(embeddings), "codes")
    # a sum beyond a long stays at its end
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    """The rounds as a chain of tables; dot products of whole numbers are exact in doubles at these sizes."""
    nearest = """
a{n} AS MATERIALIZED (
  SELECT x.rid, x.part, x.v, arg_min(c.entry, (x.q - 2 * list_dot_product(x.v, c.v) + c.q, c.entry)) AS entry,
         CAST(min(x.q - 2 * list_dot_product(x.v, c.v) + c.q) AS BIGINT) AS error
  FROM x JOIN c{n} c USING (part) GROUP BY x.rid, x.part, x.v),"""
    moved = """
m{n} AS (SELECT part, entry, i, CAST(floor(sum(v[i]) / count(*)) AS DOUBLE) AS y
         FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{b}) GROUP BY part, entry, i),
u{n} AS (SELECT part, entry, list(y ORDER BY i) AS v FROM m{n} GROUP BY part, entry),
c{n} AS MATERIALIZED (SELECT part, entry, coalesce(u{n}.v, c{b}.v) AS v,
                             list_dot_product(coalesce(u{n}.v, c{b}.v), coalesce(u{n}.v, c{b}.v)) AS q
                      FROM c{b} LEFT JOIN u{n} USING (part, entry)),"""
    steps = nearest.format(n=0) + "".join(moved.format(n=n, b=n - 1) + nearest.format(n=n) for n in range(1, rounds + 1))
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v
      FROM e, (SELECT unnest(range({PARTS})) AS part)),
x AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS q FROM p),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v, q FROM x WHERE rid <= {ENTRIES}),{steps}
coded AS (SELECT rid, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code,
                 CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, entry))
                 AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN e USING (rid), books
"""


ORACLE = _oracle()
