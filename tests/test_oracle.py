"""Every registered job against its DuckDB oracle (or rows-only) at sf0.001."""

import pytest

from quaymind.plans.registry import load_all

REG = load_all()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb
    from quaymind.sources.fixtures import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, sf, duck, name):
    q = REG[name]
    df = q.run(spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if q.oracle is None:
        assert df.schema is not None
        return
    res = duck.execute(q.oracle)
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert rows == drows


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
