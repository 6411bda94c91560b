"""G1 on all kinds of columns, held against one aggregation per column."""

from decimal import Decimal

from pyspark.sql import functions as F

from quaymind.operators import profile as P

SCHEMA = ("i int, l bigint, f float, d double, m decimal(20,3), s string, b binary, t timestamp, n timestamp_ntz, y date, "
          "a array<string>, r struct<x:int,y:string>, z boolean, `odd name.` string, nothing string")


def _table(spark):
    import datetime as dt
    day, utc = dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 23, 59, 59, 123456)
    rows = [(i % 7, (1 << 62) + i % 3, i / 3, [0.0, -0.0, float("nan"), float("inf"), 0.1, None][i % 6], None if i % 5 else Decimal(i) / 8,
             f"v{i % 11}", bytes([i % 4, 255]), utc + dt.timedelta(microseconds=i % 2), utc - dt.timedelta(days=i % 3),
             day + dt.timedelta(days=i % 9), [["a, b"], ["a", "b"], [None], None][i % 4], (i % 2, None if i % 3 else "q"), i % 2 == 0,
             "" if i % 2 else None, None) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_statistics_match_one_aggregation_per_column(spark):
    df = _table(spark)
    got = {r["name"]: r.asDict() for r in P.profile_columns(df).collect()}
    assert [r["ordinal"] for r in sorted(got.values(), key=lambda r: r["ordinal"])] == list(range(1, len(df.columns) + 1))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        want = df.agg(F.count(c).alias("n"), F.count_distinct(c).alias("d")).head()
        r = got[f.name]
        assert (r["type"], r["nullable"]) == (f.dataType.simpleString(), f.nullable)
        assert (r["null_pct"], r["distinct_count"]) == (round((60 - want["n"]) / 60 * 100, 2), want["d"]), f.name
        if isinstance(f.dataType, P.NUMERIC):
            lo, hi = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).head()
            assert repr((r["min_num"], r["max_num"])) == repr((lo, hi)).replace("-0.0", "0.0")
        elif isinstance(f.dataType, P.TEMPORAL):
            assert (r["min_time"], r["max_time"]) == tuple(df.agg(F.date_format(F.min(c), P.TS_FORMAT), F.date_format(F.max(c), P.TS_FORMAT)).head())
        else:
            assert r["min_num"] is r["max_num"] is r["min_time"] is None


def test_empty_table(spark):
    got = P.profile_columns(_table(spark).limit(0)).collect()
    assert len(got) == 15 and {(r["null_pct"], r["distinct_count"], r["min_num"], r["max_time"]) for r in got} == {(0.0, 0, None, None)}


def test_shuffles_do_not_depend_on_the_number_of_columns(spark):
    wide = spark.range(20).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    plans = [P.profile_columns(d)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
             for d in (wide.select("c0"), wide)]
    assert plans == [2, 2]
    assert {r["distinct_count"] for r in P.profile_columns(wide).collect()} == {20}


def test_profile_json_values(spark):
    """G4 read back as rows: columns, top values and samples."""
    import json
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, t string")
    doc = json.loads(P.profile_json(df, "x", top_n=1, sample=2).head()["profile"])
    assert (doc["table"], doc["row_count"]) == ("x", 4)
    by_name = {c["name"]: c for c in doc["columns"]}
    assert [c["name"] for c in doc["columns"]] == ["id", "t"]
    assert (by_name["id"]["min_num"], by_name["id"]["max_num"], by_name["id"]["distinct_count"]) == (1.0, 4.0, 4)
    assert (by_name["t"]["null_pct"], by_name["t"]["top_values"]) == (25.0, [{"value": "b", "cnt": 2}])
    assert doc["samples"] == [{"id": 1, "t": "a"}, {"id": 2, "t": "b"}]
    assert spark.createDataFrame([(json.dumps(doc),), ("[1]",), ("{}",)], "p string").select(P.valid_profile("p").alias("v")) \
        .collect() == [(True,), (False,), (False,)]


def test_changed_rows_broadcasts_no_side(spark):
    from quaymind.operators.profile import changed_rows
    old = spark.createDataFrame([(1, 11, "a"), (2, 21, "b")], "product_id bigint, variant_id bigint, handle string")
    new = spark.createDataFrame([(1, 11, "a"), (2, 21, "c"), (3, 31, "d")], "product_id bigint, variant_id bigint, handle string")
    out = changed_rows(old, new, cols=["product_id", "variant_id", "handle"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["product_id"] for r in out.collect()) == [2, 3]
