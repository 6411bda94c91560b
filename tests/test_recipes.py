"""Recipes: compositions over U1 with a scripted provider."""

import json
import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from quaymind.operators import recommend as R
from quaymind.operators.vectors import encode_texts, hash_encoder
from quaymind.plans import recipes as RC


def test_emotion_and_earlier_reply(spark):
    class Script:
        def generate(self, prompt, model):
            if "emotion" in prompt:
                return '{"emotion": "Worried"}' if "late" in prompt else '{"emotion": "happy"}'
            return "NO_MATCH" if "nothing" in prompt else "the earlier answer"

    msgs = spark.createDataFrame([(1, "my order is  late"), (2, "   "), (3, "great")], "id bigint, text string")
    got = {r["id"]: r["emotion"] for r in RC.label_emotion(msgs, Script, model="m").collect()}
    assert got == {1: "worried", 2: "", 3: ""}
    turns = spark.createDataFrame([(1, 0, "q1"), (1, 1, "a1"), (2, 0, "nothing here"), (3, 0, "  ")],
                                  "conv_id bigint, turn bigint, text string")
    qs = spark.createDataFrame([(1, "next?"), (2, "nothing?"), (3, "x")], "conv_id bigint, question string")
    got = {r["conv_id"]: r["reply"] for r in RC.find_earlier_reply(turns, qs, Script, model="m").collect()}
    assert got == {1: "the earlier answer", 2: None, 3: None}


def test_summaries_keep_previous_without_turns(spark):
    class Echo:
        def generate(self, prompt, model):
            return "summary:" + prompt.splitlines()[-1]

    turns = spark.createDataFrame([(1, 0, "hello"), (1, 1, "bye")], "conv_id bigint, turn bigint, text string")
    prev = spark.createDataFrame([(1, "old"), (2, "  kept  ")], "conv_id bigint, previous_summary string")
    got = {r["conv_id"]: r["summary"] for r in RC.summarise_conversations(turns, prev, Echo, model="m").collect()}
    assert got == {1: "summary:bye", 2: "kept"}


def test_messages_are_planned_once_encoded_and_answered(spark, tmp_path):
    calls = str(tmp_path)
    plans = {"cheap nova": {"search_query": "nova phone", "recommended_model": "nova-1", "price_max": 200},
             "any orb": {"search_query": "orb phone", "recommended_model": "not-sold"},
             "dear": {"search_query": "orb", "price_min": 5000}, "blank": {"search_query": "", "recommended_model": ""}}

    class Planner:
        def generate(self, prompt, model):
            open(os.path.join(calls, uuid.uuid4().hex), "w").close()
            said = prompt.split("Query: ")[1]
            return next((json.dumps(v) for k, v in plans.items() if said.startswith(k)), "no plan")

    names = ["nova-1", "orb-2"]
    catalog = spark.createDataFrame([(i, 10 * i, names[i], str(100 + 800 * i)) for i in range(2)],
                                    "product_id bigint, variant_id bigint, handle string, price string")
    catalog = catalog.select("*", *[F.lit(None).cast("string").alias(c) for c in
                                    ("spec", "condition", "color", "vendor", "product_type", "tenure")])
    corpus = encode_texts(catalog.select("product_id", "variant_id", F.concat(F.replace("handle", F.lit("-"), F.lit(" ")),
                                                                              F.lit(" phone")).alias("s")), "s").drop("s")
    texts = ["cheap nova", "any orb", "dear", "blank", "orb 2 phone", None]
    msgs = spark.createDataFrame([(i, t, "seen before" if i == 1 else None) for i, t in enumerate(texts)],
                                 "message_id bigint, text string, summary string")
    out = RC.recommend_messages(msgs, corpus, catalog, Planner, model="m", stopwords=["the"], summary="summary",
                                allowed=R.available_models(catalog, "", None), models=1)
    got = {r["message_id"]: r for r in out.collect()}
    assert len(os.listdir(calls)) == len(texts) and sorted(got) == list(range(len(texts)))
    want = ["nova-1 nova phone", "orb phone", "orb", "blank", "orb 2 phone", ""]     # C12: a blank search is the text itself
    assert [got[i]["effective_query"] for i in range(6)] == want
    assert [got[i]["error"] is None for i in range(6)] == [True, True, True, True, False, False]
    assert [got[i]["found"] for i in range(6)] == [True, True, False, True, True, False]
    assert "5000.0" in got[2]["answer"]
    # the best product by plain inner products, within the price bound
    enc = hash_encoder(64)
    products = enc(pd.Series(["nova 1 phone", "orb 2 phone"]))
    for i, title in ((0, "Nova 1"), (1, "Orb 2"), (4, "Orb 2")):
        scores = [float(enc(pd.Series([want[i]]))[0] @ p) for p in products]
        assert scores.index(max(scores)) == ("Nova 1", "Orb 2").index(title)
        assert title in got[i]["answer"]


def test_encoded_sentences_match_a_plain_encoder(spark, sf):
    """V1 over the whole catalog: every vector against counts of hashed words and word pairs."""
    import math
    import re

    import xxhash

    from quaymind.operators import project as P
    from quaymind.sources.fixtures import register
    register(spark, sf)
    rows = encode_texts(P.describe_rows(spark.table("catalog")), "sentence", batch_size=7).select("sentence", "embedding").collect()
    assert len(rows) == spark.table("catalog").count()
    for r in rows:
        words = re.findall("[a-z0-9]+", (r["sentence"] or "").lower())
        want = [0.0] * 64
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            h = xxhash.xxh64(term.encode()).intdigest()
            want[h % 64] += 1 if h >> 32 & 1 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert max(abs(a - b / norm) for a, b in zip(r["embedding"], want)) < 1e-6


def test_stock_prompt_takes_the_first_schema_given(spark):
    msgs = spark.createDataFrame([(1, "how many blue phones?"), (2, None)], "id bigint, text string")

    def prompts(*args, **more):
        return {r["id"]: r["prompt"] for r in RC.stock_query_prompt(msgs, *args, **more).collect()}

    profile = prompts('{"columns": []}', given="given", default_ddl="ddl")
    assert '{"columns": []}' in profile[1] and profile[1].endswith("Request: how many blue phones?")
    assert "given" not in profile[1] and profile[2].rstrip().endswith("Request:")
    assert "Table:\ngiven" in prompts(None, given="given", default_ddl="ddl")[1]
    assert "Table:\nddl" in prompts("", default_ddl="ddl")[1]


def test_a_catalog_of_one_file_is_encoded_by_all_cores(spark, sf, monkeypatch):
    from quaymind.plans import q_models
    asked = []
    monkeypatch.setattr(q_models, "encode_texts", lambda df, *a, **k: asked.append(df.rdd.getNumPartitions()) or encode_texts(df, *a, **k))
    q_models.v4_messages(spark, sf)
    assert asked and asked[0] >= spark.sparkContext.defaultParallelism


def test_messages_of_one_file_are_planned_by_all_cores(spark, sf, monkeypatch):
    from quaymind.plans import q_models
    asked = []
    monkeypatch.setattr(q_models.RC, "recommend_messages", lambda messages, *a, **k: asked.append(messages.rdd.getNumPartitions()))
    q_models.v4_messages(spark, sf)
    assert asked and asked[0] >= spark.sparkContext.defaultParallelism


def test_intro_finds_its_rows_once(spark):
    """Prompts and narrowed rows both read the search's rows: it isn't run for each."""
    class Intro:
        def generate(self, prompt, model):
            return "Take the blue mug" if "User: hi\nBot: hello" in prompt else "none of them"

    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def searched(handle):
        runs.add(1)
        return handle

    cols = ["color", "spec", "condition", "price"]
    rows = spark.createDataFrame([(1, 1, "blue-mug", 7), (1, 2, "red-cup", 7), (2, 1, "blue-mug", 8), (2, 2, "red-cup", 8)],
                                 "query_id bigint, position bigint, h string, conv_id bigint")
    rows = rows.select("query_id", "position", searched("h").alias("handle"), "conv_id", F.lit("mugs").alias("query"),
                       *[F.lit("x").alias(c) for c in cols])
    pairs = spark.createDataFrame([(7, 0, "hi", "hello")], "conv_id bigint, turn bigint, user_text string, bot_text string")
    out = RC.recommendation_intro(rows, pairs, Intro, model="m").select("query_id", "handle", "reply").collect()
    assert sorted(map(tuple, out)) == [(1, "blue-mug", "Take the blue mug"), (2, "blue-mug", "none of them"),
                                       (2, "red-cup", "none of them")]
    assert runs.value == 4
