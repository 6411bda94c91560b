"""Model-call failure paths, sources and column placement."""

import pytest
from quaymind.operators.infer import ProviderError, generate_replies
from quaymind.operators.project import reorder_columns, sanitize_text
from quaymind.sources.tables import load_knowledge_base, scan_stores


def test_generate_replies_paths(spark):
    class Flaky:  # defined locally so it is shipped by value to the workers
        def generate(self, prompt, model):
            if prompt == "busy" and model == "main":
                raise ProviderError(503)
            if prompt == "bad":
                raise ProviderError(400)
            if prompt == "blank":
                return "  "
            return f"{model}:{prompt}"

    df = spark.createDataFrame([("ok",), ("busy",), ("bad",), ("blank",)], "p string")
    got = {r["p"]: (r["reply"], r["error"], r["model_used"]) for r in
           generate_replies(df, "p", Flaky, model="main", fallback_model="alt").collect()}
    assert got["ok"] == ("main:ok", None, "main")
    assert got["busy"] == ("alt:busy", None, "alt")
    assert got["bad"][0] is None and "400" in got["bad"][1]
    assert got["blank"] == ("", None, "main")
    dflt = {r["p"]: r["reply"] for r in
            generate_replies(df, "p", Flaky, model="main", default_text="sorry").collect()}
    assert dflt == {"ok": "main:ok", "busy": "sorry", "bad": "sorry", "blank": "sorry"}


def test_scan_stores_multiline_csv(spark, tmp_path):
    p = tmp_path / "stores.csv"
    p.write_text('id, name ,whatsappLink,location,operatingHours\r\n1, A Kiosk ,w1,"Unit 1,\nLevel 2",10-10 \r\n'
                 '2,B (Temporarily Closed),w2,"X, Y",\r\n', encoding="utf-8")
    rows = scan_stores(spark, str(p)).orderBy("id").collect()
    assert [(r["id"], r["name"], r["location"], r["operatingHours"]) for r in rows] == [
        (1, "A Kiosk", "Unit 1,\nLevel 2", "10-10"), (2, "B (Temporarily Closed)", "X, Y", "")]


def test_knowledge_base_and_reorder(spark):
    df = spark.createDataFrame([(1, "k", "a", None)], "`Unnamed: 0` int, ` Keyword` string, `ANSWER ` string, x string")
    assert load_knowledge_base(df).columns == ["keyword", "answer", "x"]
    with pytest.raises(ValueError):
        load_knowledge_base(df.drop(" Keyword"))
    d2 = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert reorder_columns(d2, {"d": "A", "a": 3}).columns == ["d", "b", "a", "c"]
    with pytest.raises(ValueError):
        reorder_columns(d2, {"d": 1, "a": 1})
    with pytest.raises(KeyError):
        reorder_columns(d2, {"zz": 1})
    bad = spark.createDataFrame([("a\x01b\x0bc\nd",)], "`h\x07` string")
    out = sanitize_text(bad)
    assert out.columns == ["h"] and out.collect()[0][0] == "abc\nd"


def test_a_table_replaced_by_itself_is_kept(spark, tmp_path):
    from quaymind.sources import tables as A
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c\x07")], "id bigint, t string").write.parquet(f"{tmp_path}/book/one")
    for _ in range(2):
        A.replace_table(A.read_table(spark, f"{tmp_path}/book", "one"), f"{tmp_path}/book", "one", {"t": "A"})
    assert sorted(tuple(r) for r in A.read_table(spark, f"{tmp_path}/book", "one").collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_append_keeps_the_old_rows(spark, tmp_path):
    from quaymind.sources import tables as A
    spark.createDataFrame([(1, "a")], "id bigint, t string").write.parquet(f"{tmp_path}/one")
    for n in (2, 3):
        A.append_table(spark.createDataFrame([("x", n)], "extra string, id bigint"), str(tmp_path), "one")
    assert sorted(tuple(r) for r in A.read_table(spark, str(tmp_path), "one").collect()) == [(1, "a", None), (2, None, "x"), (3, None, "x")]


def test_a_corrupt_store_is_an_error_and_a_missing_one_is_empty(spark, tmp_path):
    import glob

    import pytest
    from quaymind.sources import tables as A
    assert A.read_embedding_store(spark, f"{tmp_path}/none", "m").count() == 0
    df = spark.createDataFrame([(1, 1, [0.5, 0.5], "h")], "product_id bigint, variant_id bigint, embedding array<float>, handle string")
    A.write_embedding_store(df, f"{tmp_path}/s", "m")
    A.write_embedding_store(df.union(df), f"{tmp_path}/s", "m")          # the new version takes the old one's place
    assert A.read_embedding_store(spark, f"{tmp_path}/s", "m").count() == 2
    assert A.read_embedding_store(spark, f"{tmp_path}/s", "other").count() == 0
    for f in glob.glob(f"{tmp_path}/s/vectors-*/*/part-*"):
        open(f, "w").write("broken")
    with pytest.raises(Exception):
        A.read_embedding_store(spark, f"{tmp_path}/s", "m").collect()


def test_large_numbers_beside_nulls_survive_model_calls(spark):
    from quaymind.operators.infer import EchoProvider, generate_replies
    df = spark.createDataFrame([(9007199254740993, "ask"), (None, "ask more")], "`odd name: id` bigint, prompt string")
    out = generate_replies(df, "prompt", EchoProvider, model="m", concurrency=2).collect()
    assert sorted(((r["odd name: id"], r["reply"]) for r in out), key=repr) == [(9007199254740993, "[m] ask"), (None, "[m] ask more")]


def test_only_queries_run(spark, tmp_path):
    import pytest
    from quaymind.sources.tables import run_sql
    spark.range(3).createOrReplaceTempView("three")
    target = f"INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet"
    for bad in (f"FROM three {target} SELECT id", f"WITH t AS (SELECT 1 AS x) {target} SELECT x FROM t", f"{target} SELECT 1",
                "DROP VIEW three", "SET a = b", "CREATE TABLE x AS SELECT 1", " "):
        with pytest.raises(Exception):
            run_sql(spark, bad)
    assert not (tmp_path / "out").exists()
    assert run_sql(spark, "(SELECT 1 AS a)").collect()[0]["a"] == 1
    assert run_sql(spark, "-- note\nWITH t AS (SELECT id FROM three) SELECT count(*) AS n FROM t").collect()[0]["n"] == 3


def test_pretty_printed_stock_file(spark, tmp_path):
    import json

    from quaymind.sources.tables import scan_nested_catalog
    (tmp_path / "stock").mkdir()
    stock = {"nova_stock": [{"model": "Nova 1", "colors": ["Red", "Blue"], "storage_price": {"64GB": 100, "128GB": 150}},
                            {"model": "Nova 2", "colors": ["Red"], "storage_price": {"64GB": 200}}]}
    (tmp_path / "stock" / "a.json").write_text(json.dumps(stock, indent=2))
    got = sorted(tuple(r) for r in scan_nested_catalog(spark, f"{tmp_path}/stock").collect())
    assert got == [("nova_stock", "Nova 1", "128GB", 150, "Blue"), ("nova_stock", "Nova 1", "128GB", 150, "Red"),
                   ("nova_stock", "Nova 1", "64GB", 100, "Blue"), ("nova_stock", "Nova 1", "64GB", 100, "Red"),
                   ("nova_stock", "Nova 2", "64GB", 200, "Red")]
