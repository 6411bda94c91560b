"""Profiling and fingerprint jobs."""

from __future__ import annotations

from quaymind.operators import profile as G
from quaymind.plans import oracle_sql as O
from quaymind.plans.registry import query
from quaymind.sources.fixtures import register

LINEITEM_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")]


def _g1_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(LINEITEM_COLS):
        num = t in ("bigint", "int", "double")
        tmp = t.startswith("timestamp")
        parts.append(f"""SELECT {i + 1} AS ordinal, '{c}' AS name, '{t}' AS type, true AS nullable,
  CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*) * 100, 2) ELSE 0.0 END AS null_pct,
  count(DISTINCT {c}) AS distinct_count,
  {f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS min_num,
  {f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS max_num,
  {f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')" if tmp else 'CAST(NULL AS VARCHAR)'} AS min_time,
  {f"strftime(max({c}), '%Y-%m-%d %H:%M:%S')" if tmp else 'CAST(NULL AS VARCHAR)'} AS max_time
FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


@query("g1_profile_columns", _g1_sql())
def g1(spark, sf):
    """G1 column profile of the whole lineitem table in one aggregation."""
    register(spark, sf)
    return G.profile_columns(spark.table("lineitem"))


@query("g2_top_values", """
SELECT column_name, value, cnt, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank FROM (
    SELECT 'c_name' AS column_name, c_name AS value, count(*) AS cnt FROM customer WHERE c_name IS NOT NULL GROUP BY c_name
    UNION ALL
    SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment))
WHERE rank <= 10""")
def g2(spark, sf):
    """G2 ten most frequent values of every text column of customer."""
    register(spark, sf)
    return G.top_values(spark.table("customer"), n=10)


@query("g3_distinct_values", O.sql(["catalog"], [], """
SELECT DISTINCT handle AS value FROM catalog WHERE handle IS NOT NULL"""))
def g3(spark, sf):
    """G3 sorted distinct catalog handles."""
    register(spark, sf)
    return G.distinct_values(spark.table("catalog"), "handle")


@query("g4_table_profile_json")
def g4(spark, sf):
    """G4 catalog profile as one JSON document, plus its validity check."""
    register(spark, sf)
    p = G.profile_json(spark.table("catalog"), "public.catalog", order=["product_id", "variant_id"])
    return p.select("profile", G.valid_profile("profile").alias("valid"))


FP_COLS = ["product_id", "variant_id", "vendor", "product_type", "handle", "color", "spec", "condition", "tenure", "price"]
ROW_HASH_SQL = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in FP_COLS) + "))"


@query("g5_row_fingerprint", O.sql(["catalog"], [], f"SELECT product_id, variant_id, {ROW_HASH_SQL} AS row_hash FROM catalog"))
def g5_rows(spark, sf):
    """G5 row hash of every catalog row."""
    register(spark, sf)
    return G.row_fingerprint(spark.table("catalog")).select("product_id", "variant_id", "row_hash")


TABLE_FP_SQL = O.sql(["catalog"], [
    ("h", f"SELECT {ROW_HASH_SQL} AS h FROM catalog"),
    ("w", """SELECT count(*) AS row_count, """ + ", ".join(
        f"coalesce(sum(CAST(CAST(('0x' || substr(h, {1 + 16 * i}, 16)) AS UHUGEINT) AS HUGEINT)), 0) AS s{i}" for i in range(4)) + " FROM h")], """
SELECT row_count, sha256(concat_ws(':', CAST(row_count AS VARCHAR), """ + ", ".join(
    f"CAST(s{i} % CAST('18446744073709551616' AS HUGEINT) AS VARCHAR)" for i in range(4)) + """)) AS fingerprint FROM w""")


@query("g5_table_fingerprint", TABLE_FP_SQL)
def g5_table(spark, sf):
    """G5 order-independent fingerprint of the whole catalog."""
    register(spark, sf)
    return G.table_fingerprint(spark.table("catalog"))


@query("g6_changed_rows", O.sql(["catalog", "catalog_next"], [], f"""
SELECT n.product_id, n.variant_id, n.handle, n.price FROM catalog_next n
WHERE NOT EXISTS (SELECT 1 FROM catalog o WHERE o.product_id = n.product_id AND o.variant_id = n.variant_id
  AND {ROW_HASH_SQL.replace('CAST(', 'CAST(o.').replace('CAST(o.(', 'CAST((')} = {ROW_HASH_SQL.replace('CAST(', 'CAST(n.')})"""))
def g6(spark, sf):
    """G6 new or changed rows between two catalog versions (left-anti on key + row hash)."""
    register(spark, sf)
    return G.changed_rows(spark.table("catalog"), spark.table("catalog_next")).select(
        "product_id", "variant_id", "handle", "price")
