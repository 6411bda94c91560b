"""Sources and sinks (A1-A12): catalog and store scans, knowledge-base
loading, nested catalog flattening, the embedding store, table append /
replace and parameterised SQL.

Writers go to caller-given paths (on a cluster: the shared folder named
by ``spark.checkpoint.dir`` or a table location), never a machine-local
temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymind.functions.text import py_strip
from quaymind.operators.project import reorder_columns, sanitize_text
from quaymind.sources import pointers

CATALOG_COLUMNS = ["product_id", "variant_id", "color", "spec", "condition", "price", "handle", "vendor",
                   "product_type", "tenure"]

CATALOG_SCHEMA = T.StructType([
    T.StructField("product_id", T.LongType()), T.StructField("variant_id", T.LongType()),
    T.StructField("color", T.StringType()), T.StructField("spec", T.StringType()),
    T.StructField("condition", T.StringType()), T.StructField("price", T.StringType()),
    T.StructField("handle", T.StringType()), T.StructField("vendor", T.StringType()),
    T.StructField("product_type", T.StringType()), T.StructField("tenure", T.StringType()),
])


def scan_catalog(source: DataFrame | str, spark: SparkSession | None = None, limit: int | None = None,
                 order: list[str] | None = None) -> DataFrame:
    """A1: the 10-column variant projection of a catalog (Parquet path or
    DataFrame); ``limit`` keeps the first rows by ``order`` (default keys)."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    out = df.select(*CATALOG_COLUMNS)
    if limit is not None:
        out = out.orderBy(*(order or ["product_id", "variant_id"])).limit(limit)
    return out


STORE_TEXT = ["name", "location", "operatingHours", "whatsappLink"]
STORES_SCHEMA = "id bigint, name string, whatsappLink string, location string, operatingHours string"


def scan_stores(spark: SparkSession, path: str, schema: str = STORES_SCHEMA) -> DataFrame:
    """A2: stores CSV with a header; quoted values may span lines; header
    names are stripped; the four text columns become stripped text with
    NULL -> ''.  Columns are matched by (stripped) header name."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .option("inferSchema", False).csv(path))
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    fields = {f.split()[0]: f.split()[1] for f in (x.strip() for x in schema.split(","))}
    cols = []
    for name in raw.columns:
        c = F.col(f"`{name}`")
        if name in STORE_TEXT:
            c = F.coalesce(py_strip(c), F.lit(""))
        elif name in fields:
            c = py_strip(c).try_cast(fields[name])  # a malformed value becomes NULL, not a failed job
        cols.append(c.alias(name))
    return raw.select(*cols)


def load_knowledge_base(df: DataFrame) -> DataFrame:
    """A3: drop columns whose header starts with 'Unnamed', strip and
    lowercase headers; error when 'keyword' or 'answer' is missing."""
    keep = [c for c in df.columns if not c.startswith("Unnamed")]
    names = [c.strip().lower() for c in keep]
    if "keyword" not in names:
        raise ValueError(f"no keyword column among {names}")
    if "answer" not in names:
        raise ValueError(f"no answer column among {names}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])


def resolve_column(df: DataFrame, name: str, rename_to: str | None = None) -> tuple[DataFrame, str]:
    """A4: find a column by trimmed, case-insensitive name (error when
    missing); optionally rename it to ``rename_to``."""
    found = next((c for c in df.columns if c.strip().lower() == name.strip().lower()), None)
    if found is None:
        raise ValueError(f"no column is called {name!r}; there are {df.columns}")
    if rename_to:
        return df.withColumnRenamed(found, rename_to), rename_to
    return df, found


STOCK_SCHEMA = "map<string, array<struct<model: string, colors: array<string>, storage_price: map<string, int>>>>"


def scan_nested_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A5: flatten nested stock records (models x storage sizes x colours)
    into variant rows ``brand, model, storage, price, color``.

    A record is an object whose keys name brands and hold arrays of models.
    ``multi_line``: each file is one (pretty-printed) object; else one object
    per line.  A record that is no such object is an error."""
    raw = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    stock = raw.select(F.explode(F.from_json("value", STOCK_SCHEMA, {"mode": "FAILFAST"})).alias("brand", "models"))
    m = stock.select("brand", F.explode("models").alias("m"))
    s = m.select("brand", F.col("m.model").alias("model"), F.col("m.colors").alias("colors"),
                 F.explode("m.storage_price").alias("storage", "price"))
    return s.select("brand", "model", "storage", "price", F.explode("colors").alias("color"))


STORE_FIELDS = ["vendor", "product_type", "handle", "color", "spec", "condition", "tenure", "price"]
META_SCHEMA = "fingerprint string, model string, row_count bigint, limit bigint"


STORE_KEYS = ["product_id", "variant_id"]
#: Buckets of a store by default; ``build_store`` takes one per 100,000 rows.
STORE_BUCKETS = 16


def store_columns(df: DataFrame) -> list[str]:
    """The columns a store is fingerprinted by: keys and product fields."""
    return [c for c in [*STORE_KEYS, *STORE_FIELDS] if c in df.columns]


def bucket_state(df: DataFrame, buckets: int) -> dict[int, list[int]]:
    """Rows and hash sums of every bucket; a few numbers per bucket."""
    from quaymind.operators.profile import bucket_sums
    rows = bucket_sums(df.drop("embedding"), STORE_KEYS, buckets, store_columns(df)).collect()
    return {r["bucket"]: [int(x) for x in tuple(r)[1:]] for r in rows}


def write_embedding_store(df: DataFrame, path: str, model: str, limit: int | None = None, buckets: int = STORE_BUCKETS,
                          keep: dict | None = None) -> DataFrame:
    """Write ``(product_id, variant_id, embedding, <product fields>)`` in
    buckets of the key under ``path/vectors-<id>`` and then its metadata
    ``fingerprint, model, row_count, limit`` as the next pointer under
    ``path/meta`` (see ``pointers``), with the place and the hash sums of every
    bucket.

    ``keep`` names buckets of earlier versions that stay as they are; ``df``
    then holds the others.  Until the pointer is there readers see the old
    store whole, and a failure at any moment leaves it in place.  Returns the
    metadata row."""
    from quaymind.operators.profile import bucket_of, combined
    spark = df.sparkSession
    after, _ = pointers.latest(spark, f"{path}/meta")
    version = f"vectors-{uuid.uuid4().hex}"
    fields = [c for c in STORE_FIELDS if c in df.columns]
    (df.select(*STORE_KEYS, "embedding", *fields).withColumn("bucket", bucket_of(STORE_KEYS, buckets))
     .repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{version}"))
    kinds = T.StructType([f for f in df.select(*STORE_KEYS, "embedding", *fields).schema.fields])
    state = bucket_state(spark.read.schema(kinds).parquet(f"{path}/{version}"), buckets)
    parts = dict(keep or {}) | {str(b): {"at": f"{version}/bucket={b}", "sums": sums} for b, sums in state.items()}
    rows, fingerprint = combined([p["sums"] for p in parts.values()])
    meta = {"fingerprint": fingerprint, "model": model, "row_count": rows, "limit": limit}
    pointers.publish(spark, f"{path}/meta", after, meta | {"buckets": buckets, "parts": parts, "schema": kinds.jsonValue()})
    return store_metadata(spark, meta)


def store_metadata(spark: SparkSession, meta: dict) -> DataFrame:
    return spark.createDataFrame([tuple(meta[c.split()[0]] for c in META_SCHEMA.split(", "))], META_SCHEMA)


def read_parts(spark: SparkSession, path: str, meta: dict, buckets: list[int] | None = None) -> DataFrame:
    """The vectors of a store's buckets (all, or those named); files of others are not opened."""
    kinds = T.StructType.fromJson(meta["schema"])
    at = [f"{path}/{p['at']}" for b, p in meta["parts"].items() if buckets is None or int(b) in set(buckets)]
    return spark.read.schema(kinds).parquet(*at) if at else spark.createDataFrame([], kinds)


def read_embedding_store(spark: SparkSession, path: str, expected_model: str) -> DataFrame:
    """The stored vectors with their product fields; empty when no write
    has completed yet or the store was built with another model.  A store that
    is there but can't be read is an error."""
    schema = ("product_id bigint, variant_id bigint, embedding array<float>, vendor string, product_type string, "
              "handle string, color string, spec string, condition string, tenure string, price string")
    _, meta = pointers.latest(spark, f"{path}/meta")
    if meta is None or meta["model"] != expected_model:
        return spark.createDataFrame([], schema)
    return read_parts(spark, path, meta)


def falsy_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """A8: '' or 0 becomes NULL in the given columns."""
    out = df
    for c in cols:
        col = F.col(c)
        is_str = isinstance(df.schema[c].dataType, T.StringType)
        falsy = (col == "") if is_str else (col == 0)
        out = out.withColumn(c, F.when(falsy, F.lit(None).cast(df.schema[c].dataType)).otherwise(col))
    return out


def append_by_name(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` appended to ``existing`` by column name; missing
    columns are NULL, existing columns first; the result is sanitised (B2)."""
    return sanitize_text(existing.unionByName(new, allowMissingColumns=True))


def append_table(new: DataFrame, folder: str, table: str) -> str:
    """A9 with its write: the named table becomes itself plus ``new``.  When
    another writer got in between, ``pointers.ConcurrentWrite`` is raised."""
    after, existing = _current(new.sparkSession, folder, table)
    return _swap_in(append_by_name(existing, new), folder, table, after)


def replace_table(df: DataFrame, folder: str, table: str, positions: dict | None = None) -> str:
    """A10: reorder (B3), sanitise (B2) and overwrite one named table under
    ``folder``; other tables in the folder are untouched.  ``df`` may come from
    the table itself.  Returns the table's path (see ``read_table``)."""
    after, _ = pointers.latest(df.sparkSession, f"{folder}/{table}/{_POINTERS}")
    return _swap_in(sanitize_text(reorder_columns(df, positions)), folder, table, after)


#: Spark's readers pass over names that start with an underscore: a plain folder stays readable under its versions.
_POINTERS, _VERSIONS = "_current", "_versions"


def _swap_in(df: DataFrame, folder: str, table: str, after: int) -> str:
    """Write a new version next to the current one, then point the table at it.

    The version that ``df`` may still read stays in place, and so does the
    table when a write fails (see ``pointers``)."""
    spark, path = df.sparkSession, f"{folder}/{table}"
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{_VERSIONS}/{version}")
    pointers.publish(spark, f"{path}/{_POINTERS}", after, {"version": version})
    return path


def _current(spark: SparkSession, folder: str, table: str) -> tuple[int, DataFrame]:
    path = f"{folder}/{table}"
    after, pointer = pointers.latest(spark, f"{path}/{_POINTERS}")
    return after, spark.read.parquet(f"{path}/{_VERSIONS}/{pointer['version']}" if pointer else path)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The current version of a table that ``replace_table`` or ``append_table``
    wrote, or a plain Parquet folder."""
    return _current(spark, folder, table)[1]


#: What a parsed query can't be or hold: commands (DDL, SET, CACHE, TRUNCATE, SHOW ..) and statements such as INSERT.
_REFUSED = ["org.apache.spark.sql.catalyst.plans.logical.Command",
            "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement",
            "org.apache.spark.sql.catalyst.plans.logical.InsertIntoDir"]


def run_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Run a caller's parameterised read-only query; blank SQL is an error.

    The statement is parsed first, and refused when its plan or any plan inside
    it (WITH, subqueries, children) is a command or a statement of Catalyst's:
    what is left are queries."""
    if not sql or not sql.strip():
        raise ValueError("the query is blank")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    loader = plan.getClass().getClassLoader()
    refused = [loader.loadClass(name) for name in _REFUSED]
    for node in _nodes(plan):
        if any(kind.isInstance(node) for kind in refused):
            raise ValueError(f"only read-only queries are allowed, not {node.nodeName()}")
    return spark.sql(sql, args=args or {})


def _nodes(plan):
    """All plans of a parsed statement: children, plans inside WITH, and subqueries in expressions."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        yield node
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            inner = group.iterator()
            while inner.hasNext():
                child = inner.next()
                if hasattr(child, "subqueries"):
                    open_.append(child)


def sample_rows(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first n rows (all columns) by an explicit order key."""
    return df.orderBy(*(order or df.columns[:1])).limit(n)
