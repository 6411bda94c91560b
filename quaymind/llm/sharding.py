"""Sharding by sampled splitters.

Keys are sampled with probability in proportion to their row's size, the
sample's quantiles become range boundaries, rows are range-partitioned by
them, and ranges that turn out overfull are subdivided by a second sample
drawn inside them.  Sorting then happens range by range, and the shards are
cut at equal byte offsets of the resulting order.

Everything runs on a slim table (keys and sizes, no texts), written once to
the shared folder.  The driver sees only boundaries and range totals, at most
``max_ranges`` of each.

Law: ``bytes``.  A row goes to the shard that holds the middle of its bytes, so
the shards' sizes differ by at most one row's size.  The result depends on
keys and sizes alone, never on the sample: the sample only decides how the
sort is spread over tasks.

Defined cases: a null text has no bytes (size 1, CRC 0); an empty table gives
no rows; equal texts are neighbours in the order (their CRC leads the key),
null ids come first within them; repeated rows each get a slot of their own,
and a random tie-breaker lets even identical rows be split over ranges; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymind.llm.common import literal_longs, materialize, project

SHARDS = 8
#: Expected sample keys for each range.
SAMPLES_PER_RANGE = 24
ROWS_PER_RANGE = 200_000
MAX_RANGES = 4_096


def _struct_literal(key: tuple, fields: list[tuple[str, str]]) -> str:
    parts = []
    for value, (name, kind) in zip(key, fields):
        text = "NULL" if value is None else (f"'{value}'" if kind == "string" else repr(value))
        parts.append(f"'{name}', CAST({text} AS {kind})")
    return f"named_struct({', '.join(parts)})"


def _range_of(key: Column, cuts: list[tuple], fields: list[tuple[str, str]]) -> Column:
    """Number of boundaries at or below the key, in two levels of about sqrt(n)."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    heads = F.expr("array(" + ",".join(_struct_literal(b[0], fields) for b in blocks) + ")")
    inner = F.expr("array(" + ",".join(
        "array(" + ",".join(_struct_literal(c, fields) for c in b) + ")" for b in blocks) + ")")
    block = F.size(F.filter(heads, lambda c: c <= key))
    within = F.size(F.filter(F.get(inner, block - 1), lambda c: c <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + within)


def _quantile_keys(sample: DataFrame, names: list[str], group: str, parts: Column) -> list[tuple]:
    """Weighted quantile boundaries of a bounded key sample, per group."""
    w = Window.partitionBy(group).orderBy(*names)
    whole = Window.partitionBy(group)
    placed = (sample.withColumn("upto", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("all", F.sum("weight").over(whole))
              .withColumn("part", F.floor((F.col("upto") - F.col("weight")) * parts / F.col("all")))
              .withColumn("before", F.lag("part").over(w)))
    rows = placed.where("part > before").select(*names).distinct().collect()
    return [tuple(r) for r in rows]


def _sorted_cuts(cuts: list[tuple]) -> list[tuple]:
    # nulls first, as Spark orders them
    return sorted(set(cuts), key=lambda k: tuple((v is not None, v if v is not None else 0) for v in k))


def place(keyed: DataFrame, keys: list[str], size: str = "size", shards: int = SHARDS, seed: int = 17,
          rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Rows of ``keyed`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    ``keys`` are orderable columns (numbers or strings without quotes);
    ``size`` is a positive long.
    """
    slim = materialize(keyed.withColumn("salt", F.floor(F.rand(seed) * (1 << 30)).cast("long")), "shard-keys")
    names = [*keys, "salt"]
    fields = [(n, dict(slim.dtypes)[n]) for n in names]
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    ranges = int(min(max_ranges, max(8 * shards, rows // rows_per_range)))
    target = max(1, total // ranges)
    key = F.struct(*[F.col(n) for n in names])
    draw = F.pmod(F.xxhash64(*[F.col(n) for n in names], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)

    want = F.col(size) * float(SAMPLES_PER_RANGE * ranges) / float(max(total, 1))
    sample = (slim.where(draw < want).select(*names, F.greatest(want, F.lit(1.0)).alias("weight"), F.lit(0).alias("rng")))
    cuts = _sorted_cuts(_quantile_keys(sample, names, "rng", F.lit(ranges))) if rows else []

    for attempt in range(3):
        ranged = slim.withColumn("rng", _range_of(key, cuts, fields))
        full = {r["rng"]: (r["b"], r["n"]) for r in
                ranged.groupBy("rng").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        over = {r: b // target + 1 for r, (b, n) in full.items() if b > 2 * target and n > 1}
        if not over or len(cuts) >= 2 * max_ranges or attempt == 2:
            break
        # subdivide the overfull ranges by splitters sampled inside them
        parts = F.expr("map(" + ",".join(f"{r}, {k}L" for r, k in over.items()) + ")")
        rate = F.expr("map(" + ",".join(
            f"{r}, {SAMPLES_PER_RANGE * k / full[r][0]!r}D" for r, k in over.items()) + ")")
        again = F.pmod(F.xxhash64(*[F.col(n) for n in names], F.lit(seed + 1 + attempt)), F.lit(1 << 40)) / float(1 << 40)
        share = F.col(size) * F.element_at(rate, F.col("rng"))
        inner = (ranged.where(F.col("rng").isin(*over)).where(again < share)
                 .select(*names, F.greatest(share, F.lit(1.0)).alias("weight"), "rng"))
        more = _sorted_cuts([*cuts, *_quantile_keys(inner, names, "rng", F.element_at(parts, F.col("rng")))])
        if len(more) == len(cuts):
            break
        cuts = more

    byte_start, row_start, b, n = [], [], 0, 0
    for r in range(len(cuts) + 1):
        byte_start.append(b)
        row_start.append(n)
        b, n = b + full.get(r, (0, 0))[0], n + full.get(r, (0, 0))[1]
    w = Window.partitionBy("rng").orderBy(*names)
    at = F.col("rng").cast("int") + 1
    offset = (F.element_at(literal_longs(byte_start), at)
              + F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    index = F.element_at(literal_longs(row_start), at) + F.row_number().over(w) - 1
    middle = (F.lit(2) * F.col("offset") + F.col(size)) * shards
    placed = materialize(
        ranged.withColumn("offset", offset).withColumn("index", index).withColumn("middle", middle)
        .withColumn("shard", F.expr(f"int(middle div {max(1, 2 * total)}L)"))
        .drop("offset", "middle", "salt", "rng"), "shard-places")
    first = {r["shard"]: r["i"] for r in placed.groupBy("shard").agg(F.min("index").alias("i")).collect()}
    start = literal_longs([first.get(s, 0) for s in range(shards)])
    return placed.withColumn("slot", F.col("index") - F.element_at(start, F.col("shard") + 1)).drop("index")


def shard_documents(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    rows = project(docs, {"doc_id": "bigint", "text": "string"})
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return place(keyed, ["text_crc32", "doc_id"], "size", shards, **options)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write the documents as one folder per shard, each in slot order of its files."""
    placed = (shard_documents(docs, shards, **options).groupBy("doc_id", "text_crc32")
              .agg(F.min("shard").alias("shard")))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    keyed = project(docs, {"doc_id": "bigint", "text": "string"}).withColumn("crc", crc)
    joined = keyed.join(placed.withColumnRenamed("doc_id", "id"),
                        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("crc") == F.col("text_crc32")))
    (joined.repartitionByRange("shard", "crc", "doc_id").sortWithinPartitions("shard", "crc", "doc_id")
     .select("doc_id", "text", "shard").write.partitionBy("shard").parquet(path))


def op1_sharding(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
