"""Versions and pointers of stored tables, and what run_sql refuses."""

import pytest

from quaymind.sources import pointers
from quaymind.sources import tables as A


def _store(spark, n):
    return spark.createDataFrame([(i, 1, [0.5, 0.5], "h") for i in range(n)],
                                 "product_id bigint, variant_id bigint, embedding array<float>, handle string")


def _broken(*_, **__):
    raise OSError("disk is full")


def test_a_rewrite_that_fails_leaves_the_old_store(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    first = A.write_embedding_store(_store(spark, 1), path, "m").head()
    assert (first["row_count"], first["model"], first["limit"]) == (1, "m", None)
    monkeypatch.setattr(pointers, "publish", _broken)
    with pytest.raises(OSError):
        A.write_embedding_store(_store(spark, 3), path, "m")
    assert A.read_embedding_store(spark, path, "m").count() == 1
    monkeypatch.undo()
    A.write_embedding_store(_store(spark, 3), path, "m", limit=9)
    assert A.read_embedding_store(spark, path, "m").count() == 3


def test_a_pointer_that_broke_off_is_passed_over(spark, tmp_path):
    path = f"{tmp_path}/s"
    A.write_embedding_store(_store(spark, 2), path, "m")
    (tmp_path / "s" / "meta" / "000000000002.json").write_text('{"model": "m", "vec')
    assert A.read_embedding_store(spark, path, "m").count() == 2
    A.write_embedding_store(_store(spark, 4), path, "m")
    assert A.read_embedding_store(spark, path, "m").count() == 4


def test_pointers_are_never_written_twice(spark, tmp_path):
    folder = f"{tmp_path}/p"
    pointers.publish(spark, folder, 0, {"v": 1})
    with pytest.raises(pointers.ConcurrentWrite):
        pointers.publish(spark, folder, 0, {"v": 2})
    assert pointers.latest(spark, folder) == (1, {"v": 1})


def test_an_append_that_another_writer_overtook_fails_and_loses_nothing(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1,)], "id bigint")
    A.replace_table(df, str(tmp_path), "t")
    sanitize = A.sanitize_text

    def overtaken(rows):
        monkeypatch.setattr(A, "sanitize_text", sanitize)
        A.append_table(spark.createDataFrame([(2,)], "id bigint"), str(tmp_path), "t")
        return sanitize(rows)
    monkeypatch.setattr(A, "sanitize_text", overtaken)
    with pytest.raises(pointers.ConcurrentWrite):
        A.append_table(spark.createDataFrame([(3,)], "id bigint"), str(tmp_path), "t")
    assert sorted(r["id"] for r in A.read_table(spark, str(tmp_path), "t").collect()) == [1, 2]


def test_a_plain_folder_stays_readable_when_its_first_replacement_fails(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(pointers, "publish", _broken)
    with pytest.raises(OSError):
        A.replace_table(spark.range(2).toDF("id"), str(tmp_path), "t")
    assert A.read_table(spark, str(tmp_path), "t").count() == 5


@pytest.mark.parametrize("statement", [
    "TRUNCATE TABLE kept", "CREATE NAMESPACE n", "CREATE VIEW v AS SELECT 1", "CREATE TEMPORARY VIEW v AS SELECT 1",
    "CACHE TABLE kept", "UNCACHE TABLE kept", "REFRESH TABLE kept", "ANALYZE TABLE kept COMPUTE STATISTICS",
    "INSERT INTO kept VALUES (9)", "DELETE FROM kept", "UPDATE kept SET id = 1", "ALTER TABLE kept RENAME TO gone",
    "MERGE INTO kept USING kept AS o ON kept.id = o.id WHEN MATCHED THEN DELETE", "DROP TABLE kept", "USE default",
    "MSCK REPAIR TABLE kept", "SET x = 1", "RESET", "ADD JAR '/x.jar'", "CREATE FUNCTION f AS 'x'", "SHOW TABLES",
    "LOAD DATA INPATH '/x' INTO TABLE kept", "EXPLAIN SELECT 1", "COMMENT ON TABLE kept IS 'x'", "DECLARE VARIABLE a INT",
    "BEGIN SELECT 1; END"])
def test_statements_that_are_no_queries_are_refused(spark, tmp_path, statement):
    spark.sql("DROP TABLE IF EXISTS kept")
    spark.range(3).write.option("path", f"{tmp_path}/kept").saveAsTable("kept")
    try:
        with pytest.raises(ValueError, match="read-only"):
            A.run_sql(spark, statement)
        assert A.run_sql(spark, "SELECT * FROM kept WHERE id IN (SELECT max(id) FROM kept)").count() == 1
        assert spark.table("kept").count() == 3
    finally:
        spark.sql("DROP TABLE kept")


def test_queries_run(spark):
    assert A.run_sql(spark, "VALUES (1), (2)").count() == 2
    assert A.run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a UNION ALL SELECT :n", {"n": 5}).count() == 2


def test_a_hot_term_is_dealt_over_tasks(spark):
    """All messages name one place that every store has: its pairs come from many tasks."""
    from pyspark.sql import functions as F
    from quaymind.operators import match as M
    messages = spark.createDataFrame([(i, "asia") for i in range(200)], "conv_id bigint, location_term string")
    dictionary = spark.createDataFrame([("asia", "Asia")], "term string, needle string")
    stores = spark.createDataFrame([(i, f"Kiosk {i}", "Unit 1, Asia") for i in range(50)], "id bigint, name string, location string")
    out = M.match_stores(messages, dictionary, stores, known_terms=True)
    made = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 200 * 50 and max(made) < 200 * 50 / 4
    assert out.select("conv_id", "store_id").distinct().count() == 200 * 50
    assert out.columns[:2] == ["location_term", "conv_id"]
