"""Source / sink and projection jobs: A1-A12, B1-B4."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quaymind.operators import project as P
from quaymind.operators import recommend as R
from quaymind.plans import oracle_sql as O
from quaymind.plans.registry import query
from quaymind.session import checkpoint_dir
from quaymind.sources import tables as A
from quaymind.sources.fixtures import register


def scratch(spark, sf: str, name: str) -> str:
    """A folder for derived tables in the shared checkpoint location."""
    tag = hashlib.sha1(sf.encode()).hexdigest()[:10]
    return f"{checkpoint_dir(spark)}/quaymind/{name}-{tag}"


CATALOG_10 = "product_id, variant_id, color, spec, condition, price, handle, vendor, product_type, tenure"


@query("a1_scan_catalog", O.sql(["catalog"], [], f"SELECT {CATALOG_10} FROM catalog"))
def a1(spark, sf):
    """A1 10-column projection of the whole derived catalog (written as Parquet, scanned back)."""
    register(spark, sf)
    path = scratch(spark, sf, "catalog")
    spark.table("catalog").write.mode("overwrite").parquet(path)
    return A.scan_catalog(path, spark)


STORES_CSV_SQL = """
SELECT id, CASE WHEN id % 3 = 0 THEN concat('  ', name, ' ') ELSE name END AS name, whatsappLink,
       CASE WHEN id % 5 = 0 THEN concat(location, '\\nLevel 2, ', operatingHours) ELSE location END AS location,
       CASE WHEN id % 4 = 0 THEN NULL ELSE concat(operatingHours, '  ') END AS operatingHours
FROM stores"""


@query("a2_scan_stores", O.sql(["stores"], [], f"""
SELECT id, {O.strip('name')} AS name, whatsappLink,
  CASE WHEN id % 5 = 0 THEN concat(location, chr(10), 'Level 2, ', operatingHours) ELSE location END AS location,
  CASE WHEN id % 4 = 0 THEN '' ELSE operatingHours END AS operatingHours
FROM stores"""))
def a2(spark, sf):
    """A2 stores written as CSV (padded names, quoted multi-line locations, missing hours) and scanned back."""
    register(spark, sf)
    path = scratch(spark, sf, "stores_csv")
    df = spark.sql(STORES_CSV_SQL).withColumnRenamed("name", " name ")
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return A.scan_stores(spark, path)


@query("a3_load_knowledge_base", O.sql(["kb"], [], "SELECT ordinal, keyword, answer FROM kb"))
def a3(spark, sf):
    """A3 knowledge base with messy headers normalised ('Unnamed' columns dropped)."""
    register(spark, sf)
    kb = spark.table("kb").select(F.col("ordinal").alias(" Ordinal "), F.col("keyword").alias("Keyword "),
                                  F.lit(None).cast("string").alias("Unnamed: 2"), F.col("answer").alias(" ANSWER"))
    return A.load_knowledge_base(kb)


@query("a4_resolve_column", O.sql(["messages"], [], "SELECT conv_id, turn, text AS question FROM messages"))
def a4(spark, sf):
    """A4 question column found by trimmed case-insensitive name and renamed."""
    register(spark, sf)
    df = spark.table("messages").select("conv_id", "turn", F.col("text").alias(" Question "))
    out, _ = A.resolve_column(df, "question", rename_to="question")
    return out


# one object per line, {brand: [models]}; a brand's models are spread over many lines
NESTED_SQL = """
SELECT to_json(map(p_brand, collect_list(named_struct(
  'model', p_name, 'colors', array_distinct(split(p_name, ' ')),
  'storage_price', map('64GB', CAST(p_retailprice AS INT), '128GB', CAST(p_retailprice AS INT) + p_size))))) AS value
FROM part GROUP BY p_brand, p_partkey DIV 50"""


@query("a5_scan_nested_catalog", """
SELECT p_brand AS brand, p_name AS model, s.storage, s.price, c.color
FROM part,
  (SELECT * FROM (VALUES ('64GB'), ('128GB')) t(storage)) st,
  LATERAL (SELECT st.storage, CASE WHEN st.storage = '64GB' THEN CAST(trunc(p_retailprice) AS INTEGER)
                              ELSE CAST(trunc(p_retailprice) AS INTEGER) + p_size END AS price) s,
  LATERAL (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS color) c""")
def a5(spark, sf):
    """A5 nested stock JSON (built from part, by brand) flattened to variant rows."""
    register(spark, sf)
    path = scratch(spark, sf, "nested_json")
    spark.sql(NESTED_SQL).write.mode("overwrite").text(path)
    return A.scan_nested_catalog(spark, path, multi_line=False)


@query("a8_falsy_to_null", O.sql(["catalog"], [], """
SELECT product_id, nullif(handle, '') AS handle, nullif(spec, '') AS spec,
  CASE WHEN product_id % 7 = 0 THEN NULL ELSE product_id % 7 END AS bucket FROM catalog"""))
def a8(spark, sf):
    """A8 '' and 0 turned into NULL on load."""
    register(spark, sf)
    df = spark.table("catalog").select("product_id", "handle", "spec", (F.col("product_id") % 7).alias("bucket"))
    return A.falsy_to_null(df, ["handle", "spec", "bucket"])


@query("a9_append_by_name", O.sql(["kb", "messages"], [], """
SELECT ordinal, regexp_replace(keyword, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS keyword,
  regexp_replace(answer, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS answer, CAST(NULL AS VARCHAR) AS source FROM kb
UNION ALL
SELECT NULL, regexp_replace(concat('q', chr(7), CAST(turn AS VARCHAR)), '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'),
  regexp_replace(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 'chat' FROM messages WHERE role = 'assistant'"""))
def a9(spark, sf):
    """A9 knowledge base + new rows from assistant turns appended by column name, then sanitised."""
    register(spark, sf)
    new = spark.table("messages").filter(F.col("role") == "assistant").select(
        F.lit("chat").alias("source"), F.col("text").alias("answer"),
        F.concat(F.lit("q\x07"), F.col("turn").cast("string")).alias("keyword"))
    folder = scratch(spark, sf, "append")
    spark.table("kb").write.mode("overwrite").parquet(f"{folder}/kb")
    A.append_table(new, folder, "kb")
    return A.read_table(spark, folder, "kb")


@query("a10_replace_table", O.sql(["kb", "stores"], [], """
SELECT 'kb' AS "table", 'answer,keyword,ordinal' AS columns, ordinal AS id, concat(answer, '|', keyword) AS body FROM kb
UNION ALL SELECT 'stores', 'id,name,whatsappLink,location,operatingHours', id, name FROM stores"""))
def a10(spark, sf):
    """A10 one table of a folder replaced by itself (reordered, sanitised); the sibling table is kept."""
    register(spark, sf)
    folder = scratch(spark, sf, "workbook")
    spark.table("kb").write.mode("overwrite").parquet(f"{folder}/kb")
    spark.table("stores").write.mode("overwrite").parquet(f"{folder}/stores")
    A.replace_table(A.read_table(spark, folder, "kb"), folder, "kb", {"answer": "A", "ordinal": 3})
    kb, st = A.read_table(spark, folder, "kb"), A.read_table(spark, folder, "stores")
    names = lambda df: F.lit(",".join(df.columns)).alias("columns")
    return kb.select(F.lit("kb").alias("table"), names(kb), F.col("ordinal").alias("id"),
                     F.concat("answer", F.lit("|"), "keyword").alias("body")).unionByName(
        st.select(F.lit("stores").alias("table"), names(st), "id", F.col("name").alias("body")))


RUN_SQL = """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem WHERE l_quantity > :min_qty GROUP BY l_returnflag, l_linestatus"""


@query("a11_run_sql", RUN_SQL.replace(":min_qty", "10"))
def a11(spark, sf):
    """A11 caller's parameterised read-only SQL over lineitem."""
    register(spark, sf)
    return A.run_sql(spark, RUN_SQL, {"min_qty": 10})


@query("a12_sample_rows", """
SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10""")
def a12(spark, sf):
    """A12 first 10 lineitem rows by an explicit order key."""
    register(spark, sf)
    return A.sample_rows(spark.table("lineitem"), 10, ["l_orderkey", "l_linenumber"])


@query("b1_describe_rows", O.sql(["catalog"], [], "SELECT product_id, concat('Vendor ', " + ", ".join(
    f"coalesce({O.strip(c)}, 'unknown'), '{sep}'" for c, sep in [
        ("vendor", " offers a "), ("product_type", " with handle "), ("handle", ", color "), ("color", ", spec "),
        ("spec", ", condition "), ("condition", ", tenure "), ("tenure", ", priced at "), ("price", ".")])
    + ") AS sentence FROM catalog"))
def b1(spark, sf):
    """B1 one descriptive sentence per catalog variant."""
    register(spark, sf)
    return P.describe_rows(spark.table("catalog")).select("product_id", "sentence")


DIRTY_DOCS = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(chr(1), left(text, 20), chr(11), substr(text, 21), chr(31))
  ELSE text END AS text, lang FROM documents"""


@query("b2_sanitize_text", O.sql([], [("dirty", DIRTY_DOCS)], """
SELECT doc_id, regexp_replace(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS text,
  regexp_replace(lang, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS lang FROM dirty"""))
def b2(spark, sf):
    """B2 control characters removed from every text cell of the (whole) documents table."""
    register(spark, sf)
    return P.sanitize_text(spark.sql(DIRTY_DOCS))


@query("b3_reorder_columns", "SELECT l_shipdate, l_orderkey, l_quantity, l_partkey, l_suppkey FROM lineitem")
def b3(spark, sf):
    """B3 lineitem columns placed at sheet positions (A and 3)."""
    register(spark, sf)
    df = spark.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return P.reorder_columns(df, {"l_shipdate": "A", "l_quantity": 3})


@query("b4_product_links", O.sql(["catalog"], [], """
SELECT product_id, concat('https://shop.example.com/products/', coalesce(handle, '')) AS product_link,
  concat('https://shop.example.com/products/', coalesce(handle, ''), '?variant=', CAST(variant_id AS VARCHAR)) AS variant_link
FROM catalog"""))
def b4(spark, sf):
    """B4 product and variant links of every catalog row (scheme and slashes stripped from the domain)."""
    register(spark, sf)
    d = "https://shop.example.com/"
    return spark.table("catalog").select("product_id", R.product_link("handle", d).alias("product_link"),
                                         R.variant_link("handle", "variant_id", d).alias("variant_link"))
