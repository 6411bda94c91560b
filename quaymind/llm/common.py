"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymind.session import checkpoint_dir

#: White space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A side of a join is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 32 << 20

DOC_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, cast to the given types, and nothing else.

    A column is found by its exact name first and by its case-insensitive
    name next, so extra columns whose names differ only in case do not make
    the reference ambiguous.
    """
    plain = df.toDF(*[f"in_{i}" for i in range(len(df.columns))])
    out = []
    for name, kind in columns.items():
        at = [i for i, c in enumerate(df.columns) if c == name] or \
             [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"column {name!r} is missing; the input has {df.columns}")
        out.append(plain[f"in_{at[0]}"].cast(kind).alias(name))
    return plain.select(*out)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage with a table that survives lost executors; the folder is the
    one that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quaymind-llm/{name}-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(nullable).parquet(path)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), "")


def literal_longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{int(v)}L" for v in values) + ")")


def global_index(df: DataFrame, keys: list[Column], column: str) -> DataFrame:
    """``df`` with its gapless row number from 0 in the order of ``keys``.

    Spark range-partitions and sorts; only one row count per partition comes
    to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("placed_at", at),
                         "index")
    part = F.shiftright("placed_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ahead, n = [], 0
    for p in range(max(counts, default=0) + 1):
        ahead.append(n)
        n += counts.get(p, 0)
    start = F.element_at(literal_longs(ahead), part.cast("int") + 1)
    return (placed.withColumn(column, start + F.col("placed_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("placed_at"))


#: Rows that travel to a Python worker at once: texts are long, and a worker holds a whole batch.
ARROW_ROWS = 1_000


def bound_arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
