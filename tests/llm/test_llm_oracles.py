"""The queries that SQL can state, next to DuckDB, and the contract of all of them."""

import pytest

from quaymind.llm.queries import ORACLES, QUERIES

TABLE = {"op2_preferences": "conversations", "op3_html": "pages", "op10_topk": "embeddings", "op13_codes": "embeddings"}


@pytest.fixture
def folder(spark, sf, tmp_path):
    """A folder that holds the benchmark items already."""
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return tmp_path


def _rows(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, sf, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert _rows(tuple(r[c] for c in cols) for r in df.collect()) == _rows(tuple(r[i] for i in at) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table_gives_no_rows(spark, sf, name, folder):
    table = TABLE.get(name, "documents")
    spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    assert QUERIES[name](spark, str(folder)).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_of_nulls_do_not_fail(spark, sf, name, folder):
    from pyspark.sql import functions as F
    table = TABLE.get(name, "documents")
    full = spark.read.parquet(f"{sf}/{table}.parquet").limit(3)
    blank = full.select(*[F.lit(None).cast(t).alias(c) for c, t in full.dtypes])
    # a repeated row, rows of nulls, an extra column whose name only differs by case and one that operators use inside
    mixed = full.unionByName(full).unionByName(blank)
    first = mixed.columns[0]
    clash = mixed.withColumn("row", F.lit("x")).toDF(*mixed.columns, "row").select("*", F.lit(1).alias("size_x"))
    assert first in clash.columns
    clash.write.parquet(f"{folder}/{table}.parquet")
    n = QUERIES[name](spark, str(folder)).count()
    assert n > 0 or name == "op10_topk"
    if table in ("documents", "pages") and name != "op12_ranked":
        assert n == 9
