"""Table profiling and fingerprints.

G1 counts (column, value) pairs once for all columns (one scan, one shuffle,
map-side combined) and derives every statistic from them.  G2 uses map-side pre-aggregation plus a partial top-n (WindowGroupLimit) so no
column's value set meets in one task.  G5's table fingerprint is an
order-independent additive hash of row hashes: partial sums per task,
no sort, no collect.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymind import fixed as X

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
#: The slots of a value: it stands in one of them, in a form that is equal exactly where the values are.
SLOTS = {"whole": "bigint", "real": "double", "txt": "string"}


def _slot(c: str, kind: T.DataType) -> tuple[str, Column]:
    if isinstance(kind, WHOLE):
        return "whole", F.col(c).cast("int").cast("bigint") if isinstance(kind, T.BooleanType) else F.col(c).cast("bigint")
    if isinstance(kind, T.DateType):
        return "whole", F.unix_date(c).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return "whole", F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return "whole", F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {c})")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "real", F.col(c).cast("double")
    if isinstance(kind, T.BinaryType):
        return "txt", F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return "txt", F.to_json(c, {"ignoreNullFields": "false"})
    return "txt", F.col(c).cast("string")


def column_values(df: DataFrame) -> DataFrame:
    """``ordinal`` of the column from 1, its value in one of the ``SLOTS`` (NULL in all for NULL) and ``cnt``, its rows.

    One scan and one shuffle for any number of columns: a row becomes one
    (column, value) pair per column, and pairs are counted map-side first.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    pairs = []
    for i, f in enumerate(df.schema.fields):
        slot, value = _slot(f"c{i}", f.dataType)
        pairs.append(F.struct(F.lit(i + 1).alias("ordinal"),
                              *[(value if s == slot else F.lit(None).cast(t)).alias(s) for s, t in SLOTS.items()]))
    return plain.select(F.inline(F.array(*pairs))).groupBy("ordinal", *SLOTS).agg(F.count(F.lit(1)).alias("cnt"))


def profile_columns(df: DataFrame) -> DataFrame:
    """G1: per column name, type, nullable, null_pct (2 decimals, 0 for an
    empty table), distinct_count, and min/max for numeric (as double) and
    date/time columns (as 'yyyy-MM-dd HH:mm:ss' text).

    Everything comes from the distinct values of :func:`column_values` and
    their counts: one scan, one shuffle of the pairs and one of a row per
    column and task.  The columns' names and types are a small local table."""
    fields = df.schema.fields
    decimals = [i + 1 for i, f in enumerate(fields) if isinstance(f.dataType, T.DecimalType)]
    # read from the text only where the column is a decimal
    exact = F.when(F.col("ordinal").isin(decimals), F.expr("try_cast(txt as double)")) if decimals else F.lit(None).cast("double")
    given = F.when(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("txt").isNotNull(), True)
    per_column = column_values(df).groupBy("ordinal").agg(
        F.sum("cnt").alias("_rows"), F.coalesce(F.sum(F.when(given, F.col("cnt"))), F.lit(0)).alias("_given"),
        F.count(given).alias("_distinct"), F.min("whole").alias("_wmin"), F.max("whole").alias("_wmax"),
        F.min(F.coalesce("real", exact)).alias("_rmin"), F.max(F.coalesce("real", exact)).alias("_rmax"))
    names = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString(), f.nullable, isinstance(f.dataType, NUMERIC)) for i, f in enumerate(fields)],
        "ordinal int, name string, type string, nullable boolean, _num boolean")
    # one row per column on both sides
    joined = names.join(F.broadcast(per_column), "ordinal", "left")

    def stamp(c: str) -> Column:
        kind = lambda t: F.col("type") == t
        day = F.expr(f"date_format(date_from_unix_date(cast(if(type = 'date', {c}, 0) as int)), '{TS_FORMAT}')")
        moment = F.date_format(F.timestamp_micros(F.when(kind("timestamp"), F.col(c))), TS_FORMAT)
        clock = F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, cast(if(type = 'timestamp_ntz', {c}, 0) as decimal(20,0)) / 1000000)")
        return F.when(F.col(c).isNull(), F.lit(None)).when(kind("date"), day).when(kind("timestamp"), moment).when(
            kind("timestamp_ntz"), F.date_format(clock, TS_FORMAT))
    number = lambda w, r: F.when(F.col("_num"), F.coalesce(F.col(w).cast("double"), F.col(r)))
    return joined.select(
        "ordinal", "name", "type", "nullable",
        F.when(F.col("_rows") > 0, F.round((F.col("_rows") - F.col("_given")) / F.col("_rows") * 100, 2)).otherwise(F.lit(0.0)).alias("null_pct"),
        F.coalesce("_distinct", F.lit(0)).alias("distinct_count"), number("_wmin", "_rmin").alias("min_num"),
        number("_wmax", "_rmax").alias("max_num"), stamp("_wmin").alias("min_time"), stamp("_wmax").alias("max_time"))


def top_values(df: DataFrame, cols: list[str] | None = None, n: int = 10) -> DataFrame:
    """The n most frequent non-NULL values of each text column
    (ties by value).  ``column_name, value, cnt, rank``."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value"))
                                        for c in cols])).alias("_kv")).select("_kv.*")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n) \
        .withColumn("rank", F.col("rank").cast("long"))


def distinct_values(df: DataFrame, col: str = "handle") -> DataFrame:
    """Sorted distinct non-NULL values of one column."""
    c = F.col(col)
    return df.select(c.alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")


FINGERPRINT_COLS = X.FINGERPRINT_COLS


def row_hash(cols: list[str] | None = None) -> Column:
    """G5 (row): SHA-256 of the '|'-joined column texts, NULL written 'None'."""
    cols = cols or FINGERPRINT_COLS
    return F.sha2(F.concat_ws(X.FINGERPRINT_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit(X.FINGERPRINT_NULL))
                                                  for c in cols]), 256)


def row_fingerprint(df: DataFrame, cols: list[str] | None = None, out: str = "row_hash") -> DataFrame:
    return df.withColumn(out, row_hash(cols))


TWO64 = 18446744073709551616


def _hash_sums(df: DataFrame, by: list[Column], cols: list[str] | None) -> DataFrame:
    """Rows and the four sums of the row hashes' 64-bit words, modulo 2**64, of every group."""
    h = row_hash(cols)
    words = [F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    names = ["bucket"] if by else []
    summed = df.select(*by, *[w.alias(f"_w{i}") for i, w in enumerate(words)]).groupBy(*names).agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(4)])
    return summed.select(*names, "row_count", *[
        F.pmod(F.coalesce(F.col(f"_s{i}"), F.lit(0).cast("decimal(38,0)")), F.lit(str(TWO64)).cast("decimal(38,0)"))
        .cast("decimal(20,0)").alias(f"s{i}") for i in range(4)])


def table_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """G5 (table): order-independent fingerprint of a table's rows.

    Each row hash is cut into four 64-bit words; the words are summed
    column-wise modulo 2**64 (a multiset hash), so partitions combine in
    any order with plain partial sums.  Result: ``row_count, fingerprint``
    where fingerprint = sha256('count:s1:s2:s3:s4')."""
    return _hash_sums(df, [], cols).select("row_count", F.sha2(F.concat_ws(":", *[
        F.col(c).cast("string") for c in ("row_count", "s0", "s1", "s2", "s3")]), 256).alias("fingerprint"))


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row: the same for rows with the same key in every version of a table."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_sums(df: DataFrame, keys: list[str], buckets: int, cols: list[str] | None = None) -> DataFrame:
    """G5 (tree): ``bucket, row_count, s0 .. s3`` of every bucket that has rows.

    The levels of the hash tree are row hashes, sums per bucket and, by
    ``combined``, the table's fingerprint; a level follows from the one below
    by addition, so partial sums combine map-side and a changed row changes
    its own bucket only."""
    return _hash_sums(df, [bucket_of(keys, buckets).alias("bucket")], cols)


def combined(sums: list[list[int]]) -> tuple[int, str]:
    """Rows and fingerprint of a table from the ``[row_count, s0 .. s3]`` of its buckets."""
    rows = sum(s[0] for s in sums)
    words = [str(sum(s[i] for s in sums) % TWO64) for i in range(1, 5)]
    return rows, hashlib.sha256(":".join([str(rows), *words]).encode()).hexdigest()


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str] | None = None,
                 cols: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` whose (key, row hash) is not in ``old`` -- new or
    changed rows, the ones to re-embed.  Left-anti join on key + hash; both
    sides are as large as the catalog, so neither is broadcast."""
    keys = keys or ["product_id", "variant_id"]
    o = old.select(*keys, row_hash(cols).alias("row_hash"))
    n = new.withColumn("row_hash", row_hash(cols))
    return n.join(o.hint("merge"), keys + ["row_hash"], "left_anti")


def profile_json(df: DataFrame, table: str, top_n: int = 10, sample: int = 10,
                 order: list[str] | None = None) -> DataFrame:
    """G1 + G2 + A12 as one JSON row ``{table, row_count, columns,
    samples}``.  Per-column top values are bounded (top_n); the unbounded
    distinct-value list (G3) stays a separate DataFrame."""
    prof = profile_columns(df)
    tv = top_values(df, n=top_n).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))),
                    lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("cnt"))).alias("top_values"))
    cols = prof.join(tv, prof["name"] == tv["column_name"], "left").drop("column_name")
    order = order or df.columns[:1]
    samples = df.orderBy(*order).limit(sample).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                                                   .alias("samples"))
    colsj = cols.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*[c for c in cols.columns if c != "ordinal"]).alias("c")))),
                                 lambda x: x["c"]).alias("columns"))
    rc = df.agg(F.count(F.lit(1)).alias("row_count"))
    # three one-row aggregates combined as scalar subqueries (no join)
    doc = F.struct(F.lit(table).alias("table"), rc.scalar().alias("row_count"),
                   colsj.scalar().alias("columns"), samples.scalar().alias("samples"))
    return df.sparkSession.range(1).select(F.to_json(doc).alias("profile"))


def valid_profile(col: Column | str) -> Column:
    """G4 check of a caller-supplied profile: a JSON object that has both
    ``columns`` and ``table`` keys."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return F.coalesce(kind.startswith("OBJECT") & has("columns") & has("table"), F.lit(False))


def pretty_profile(profile_text: str) -> str:
    """Driver-side pretty print of an already-small profile JSON text."""
    return json.dumps(json.loads(profile_text), indent=2, ensure_ascii=False)
