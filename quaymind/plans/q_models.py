"""Model-backed and streaming jobs: V1, V5, U1, T1, T2 (rows-only checks;
the pytest suite compares them with brute force / the batch operators)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaymind import fixed as X
from quaymind.operators import classify as C
from quaymind.operators import project as P
from quaymind.operators.infer import EchoProvider, OptionProvider, ScriptedProvider, generate_replies
from quaymind.operators.ledger import replies_once
from quaymind.functions import text as T
from quaymind.operators.vectors import encode_texts
from quaymind.plans.q_sources import scratch
from quaymind.plans.registry import query
from quaymind.plans.store_build import build_store, changed_since, refresh_store
from quaymind.sources.fixtures import VOCABULARIES, register
from quaymind.sources.tables import read_embedding_store
from quaymind.streaming import jobs as S

V = VOCABULARIES


@query("v1_encode_texts")
def v1(spark, sf):
    """V1 catalog sentences encoded to unit vectors (hashing stand-in encoder)."""
    register(spark, sf)
    enc = encode_texts(P.describe_rows(spark.table("catalog")), "sentence", batch_size=32)
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return enc.select("product_id", F.size("embedding").alias("dims"), F.round(F.sqrt(sq), 6).alias("norm"))


@query("v5_build_store")
def v5(spark, sf):
    """V5 store build (scan -> sentences -> encode -> fingerprint -> write), read back through A7."""
    register(spark, sf)
    path = scratch(spark, sf, "store")
    build_store(spark.table("catalog"), path, model="hash-64")
    vec = read_embedding_store(spark, path, "hash-64")
    return vec.select("product_id", "variant_id", F.size("embedding").alias("dims"), "handle", "price")


@query("v5_refresh_store")
def v5_refresh(spark, sf):
    """V5 in place: the store of the catalog brought up to its next version; only changed rows are encoded."""
    register(spark, sf)
    path = f"{scratch(spark, sf, 'refreshed')}-{uuid.uuid4().hex}"
    build_store(spark.table("catalog"), path, model="hash-64")
    refresh_store(spark.table("catalog_next"), path, model="hash-64")
    vec = read_embedding_store(spark, path, "hash-64")
    return vec.select("product_id", "variant_id", F.size("embedding").alias("dims"), "handle", "price")


@query("g6_changed_since_store")
def g6_since(spark, sf):
    """G6 against a store: rows of the next catalog that differ from the stored ones, from the buckets that differ."""
    register(spark, sf)
    path = f"{scratch(spark, sf, 'since')}-{uuid.uuid4().hex}"
    build_store(spark.table("catalog"), path, model="hash-64")
    return changed_since(spark.table("catalog_next"), path, "hash-64").select("product_id", "variant_id", "handle", "price")


@query("u1_generate_replies")
def u1(spark, sf):
    """U1 batch replies for every user message prompt (retry, default text and error paths)."""
    register(spark, sf)
    prompts = spark.table("messages").filter(F.col("role") == "user").select(
        "conv_id", "turn", F.concat(F.lit("Answer briefly.\n"), F.col("text")).alias("prompt"))
    return generate_replies(prompts, "prompt", lambda: EchoProvider("primary"), model="primary",
                            fallback_model="secondary", default_text=None)


@query("u1_reply_ledger")
def u1_ledger(spark, sf):
    """U1 through a reply ledger: each distinct prompt of the user messages is asked once."""
    register(spark, sf)
    prompts = spark.table("messages").filter(F.col("role") == "user").select(
        "conv_id", "turn", F.concat(F.lit("Answer briefly.\n"), F.col("text")).alias("prompt"))
    ledger = f"{scratch(spark, sf, 'ledger')}-{_run_id()}"
    return replies_once(prompts, "prompt", lambda: EchoProvider("primary"), ledger, model="primary", fallback_model="secondary",
                        buckets=spark.sparkContext.defaultParallelism)


def _plan_stream_input(spark, sf):
    from quaymind.plans.q_documents import HANDLES_SQL, PLAN_SQL
    plan = spark.sql(PLAN_SQL).withColumn("is_refinement", C.is_refinement("text", V["refinement"]))
    hs = spark.sql(HANDLES_SQL.replace("[", "array(").replace("] END", ") END")).select("conv_id", "turn", "handles")
    return plan.join(hs, ["conv_id", "turn"]).select("conv_id", "turn", "search_query", "recommended_model",
                                                     "is_refinement", "handles")


@query("t1_stream_route")
def t1(spark, sf):
    """T1 user messages streamed from Parquet files through routing + escalation (availableNow)."""
    from quaymind.plans.q_classify import _ranked
    from quaymind.plans.q_text import _label_replies_spark
    register(spark, sf)
    base = scratch(spark, sf, "t1")
    src = f"{base}/in"
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    um.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(um.schema).option("maxFilesPerTrigger", 2).parquet(src)   # several micro-batches
    out = S.stream_route(stream, _label_replies_spark(spark), spark.table("kb"), V, _ranked(spark))
    sink = f"{base}/out-{_run_id()}"
    S.run_available_now(out, sink, f"{sink}-ckpt")
    return spark.read.parquet(sink).drop("text")


@query("t2_stream_carry_query")
def t2(spark, sf):
    """T2 carried query/handles per conversation as streaming keyed state (applyInPandasWithState)."""
    register(spark, sf)
    base = scratch(spark, sf, "t2")
    run = _run_id()
    src, sink = f"{base}/in-{run}", f"{base}/out-{run}"
    inp = _plan_stream_input(spark, sf)
    # early turns arrive and are processed first, later ones afterwards: the state carries over in between
    for arriving in (inp.where("turn < 3"), inp.where("turn >= 3")):
        arriving.repartition("conv_id").write.mode("append").parquet(src)
        stream = spark.readStream.schema(inp.schema).parquet(src)
        S.run_available_now(S.stream_carry_query(stream), sink, f"{sink}-ckpt")
    out = spark.read.parquet(sink)
    return out.select("conv_id", "turn", "effective_query",
                      F.array_join("preferred_handles", "|").alias("preferred_handles"))


@query("t1_stream_model")
def t1_model(spark, sf):
    """T1 with the model called inside the stream: every user message labelled once, through a reply ledger."""
    from quaymind.plans.q_classify import _ranked
    register(spark, sf)
    base = f"{scratch(spark, sf, 't1-model')}-{_run_id()}"
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    um.write.mode("overwrite").parquet(f"{base}/in")
    # the stand-in names one of two keywords, logs a ticket or finds nothing, by the prompt's length
    said = [r["keyword"] for r in spark.table("kb").orderBy("ordinal").select("keyword").limit(2).collect()]
    script = [*said, *[""] * (2 - len(said)), "  Logging_Ticket ", "NO_MATCH"]
    stream = spark.readStream.schema(um.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    S.run_route(stream, lambda m: m.withColumn("prompt", F.concat(F.lit("Pick a label.\n"), F.col("text"))),
                lambda: ScriptedProvider(script, "primary"), spark.table("kb"), V, _ranked(spark), sink=f"{base}/out",
                checkpoint=f"{base}/ckpt", ledger=f"{base}/ledger", model="primary", fallback_model="secondary",
                buckets=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{base}/out").drop("text", "batch")


@query("t2_stream_ordered")
def t2_ordered(spark, sf):
    """T2 for turns in any order: they arrive dealt over three micro-batches by a hash, and are answered in order."""
    register(spark, sf)
    base = f"{scratch(spark, sf, 't2-ordered')}-{_run_id()}"
    numbered = _plan_stream_input(spark, sf).withColumn("place", F.row_number().over(
        Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1).persist()
    given = numbered.withColumn("asked_turn", F.col("turn")).withColumn("turn", F.col("place")).withColumn(
        "at", F.timestamp_seconds(F.col("place") * 60))
    arrives = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    for n in range(3):
        given.where(arrives == n).drop("asked_turn", "place").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(given.drop("asked_turn", "place").schema).parquet(f"{base}/in")
        S.run_available_now(S.stream_carry_ordered(stream, "at", "30 days"), f"{base}/out", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/out").withColumnRenamed("turn", "place")
    return numbered.select("conv_id", "place", "turn").join(out, ["conv_id", "place"]).select(
        "conv_id", "turn", "effective_query", F.array_join("preferred_handles", "|").alias("preferred_handles"))


def _run_id() -> str:
    import uuid
    return uuid.uuid4().hex[:12]


# ---- A6 / A7 and the model-backed recipes (rows-only; pytest covers paths) ----

from quaymind.plans import recipes as RC  # noqa: E402
from quaymind.sources.tables import write_embedding_store  # noqa: E402


def _store_input(spark):
    emb = spark.table("embeddings").select(F.col("vec_id").alias("product_id"),
                                           (F.col("vec_id") * 10 + 1).alias("variant_id"), "embedding")
    return emb.join(spark.table("catalog"), ["product_id", "variant_id"], "left")


@query("a6_write_embedding_store")
def a6(spark, sf):
    """A6 embeddings + product fields written as a vector store with its metadata row."""
    register(spark, sf)
    return write_embedding_store(_store_input(spark), scratch(spark, sf, "a6_store"), "given-64")


@query("a7_read_embedding_store")
def a7(spark, sf):
    """A7 store read back with the expected model (rows) and a wrong model (empty)."""
    register(spark, sf)
    path = scratch(spark, sf, "a7_store")
    write_embedding_store(_store_input(spark), path, "given-64")
    ok = read_embedding_store(spark, path, "given-64").select("product_id", "variant_id", "handle",
                                                              F.lit("given-64").alias("asked"))
    bad = read_embedding_store(spark, path, "other-model").select("product_id", "variant_id", "handle",
                                                                  F.lit("other-model").alias("asked"))
    return ok.unionByName(bad)


def _provider():
    return EchoProvider("primary")


@query("u1_recipe_label_messages")
def r_label(spark, sf):
    """Recipe: knowledge-base labelling of every user message (B6 -> U1 -> C13 -> J3)."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return RC.label_messages(um, spark.table("kb"), lambda: OptionProvider("primary"), model="primary",
                             fallback_model="secondary")


@query("u1_recipe_summarise")
def r_summary(spark, sf):
    """Recipe: conversation summaries (G9 -> B6 -> U1; no turns keeps the previous summary)."""
    register(spark, sf)
    prev = spark.table("questions").select("conv_id", F.concat(F.lit("asked: "), F.col("question")).alias("previous_summary"))
    return RC.summarise_conversations(spark.table("history"), prev, _provider, model="secondary")


@query("u1_recipe_earlier_reply")
def r_earlier(spark, sf):
    """Recipe: earlier reply lookup by the model (G9 -> B6 -> U1 -> C15)."""
    register(spark, sf)
    return RC.find_earlier_reply(spark.table("history"), spark.table("questions"), _provider, model="secondary")


# what the stand-in model says about a message's emotion: known labels in any case, an unknown one, and no JSON
EMOTION_SCRIPT = ['{"emotion": "worried"}', '{"emotion": "SAD"}', '{"emotion": "puzzled"}', "no idea", '{"emotion": "Confused"}']


@query("u1_recipe_emotion")
def r_emotion(spark, sf):
    """Recipe: emotion labels of every user message (C11 -> B6 -> U1 -> C14)."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return RC.label_emotion(um, lambda: ScriptedProvider(EMOTION_SCRIPT), model="secondary")


@query("u1_recipe_faq_answer")
def r_faq(spark, sf):
    """Recipe: FAQ answers (P5 -> J8 -> B6 -> U1 with default text)."""
    from quaymind.operators.documents import split_sections
    from quaymind.sources.fixtures import faq_keywords_df
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select(
        "conv_id", "turn", "text", F.col("conv_id").alias("doc_id"))
    return RC.answer_from_faq(um, faq_keywords_df(spark), split_sections(spark.table("faq_docs")), _provider,
                              model="primary", strong=V["strong_faq"], weak=V["weak_faq"]).drop("prompt")


@query("u1_recipe_store_replies")
def r_store(spark, sf):
    """Recipe: store replies for location questions (P12 -> J4 -> B6 -> U1, else B7 list)."""
    from quaymind.plans.q_classify import _ranked
    register(spark, sf)
    ranked = _ranked(spark)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    loc = um.filter(C.is_location_query("text", V["strong_location"], V["weak_location"], ranked))
    from quaymind.plans.q_match import FIXED_REPLIES
    out = RC.store_replies(loc, spark.table("locations"), spark.table("stores"), _provider, model="primary",
                           malay=V["malay"], ranked_terms=ranked, fixed_replies=FIXED_REPLIES)
    return out.select("conv_id", "turn", "language", "location_term", "reply")


@query("u1_recipe_rewrite_queries")
def r_rewrite(spark, sf):
    """Recipe: search-query rewrite (B6 -> U1 -> C12 -> S4 against available handles)."""
    register(spark, sf)
    from quaymind.operators import recommend as R
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    allowed = R.available_models(spark.table("catalog"), "", None)
    return RC.rewrite_search_queries(um, _provider, model="primary", allowed=allowed)


# what the stand-in model makes of a message: a plain search, a model with prices, a price as text, no JSON
PLAN_SCRIPT = ['{"search_query": "almond blue", "recommended_model": "", "price_min": null, "price_max": null}',
               '{"search_query": "large", "recommended_model": "unknown-9", "price_min": 3000, "price_max": 4000}',
               '{"search_query": "small steel", "recommended_model": null, "price_max": "3,500"}', "no plan"]


@query("v4_recommend_messages")
def v4_messages(spark, sf):
    """V4 from the text of every user message: rewrite -> encode -> search the catalog's sentences -> cards."""
    from quaymind.operators import recommend as R
    register(spark, sf)
    # messages of few files are planned, and a catalog of few files is encoded, by all cores
    tasks = 2 * spark.sparkContext.defaultParallelism
    um = spark.table("messages").filter(F.col("role") == "user").select(
        (F.shiftleft(F.col("conv_id"), 16) + F.col("turn")).alias("message_id"), "text").repartition(tasks)
    catalog = spark.table("catalog")
    sentences = P.describe_rows(catalog).select("product_id", "variant_id", "sentence").repartition(tasks)
    corpus = encode_texts(sentences, "sentence").select("product_id", "variant_id", "embedding")
    return RC.recommend_messages(um, corpus, catalog, lambda: ScriptedProvider(PLAN_SCRIPT), model="primary",
                                 fallback_model="secondary", stopwords=V["stopwords"],
                                 allowed=R.available_models(catalog, "", None))


@query("u1_recipe_sales_redirect")
def r_sales(spark, sf):
    """Recipe: sales-redirect replies for messages routed nowhere else (B6 -> U1)."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    products = '[{"handle": "sample-phone", "price": 1000}]'
    return RC.sales_redirect(um, products, _provider, model="primary").drop("prompt")


@query("u1_recipe_stock_prompt")
def r_stock(spark, sf):
    """Recipe: stock-query prompts carrying the catalog profile (G4 -> B6, no model call)."""
    from quaymind.operators.profile import profile_json
    register(spark, sf)
    prof = profile_json(spark.table("catalog"), "public.catalog", order=["product_id", "variant_id"]).head()[0]
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return RC.stock_query_prompt(um, prof).select("conv_id", "turn", F.length("prompt").alias("prompt_chars"))


@query("u1_recipe_recommendation_intro")
def r_intro(spark, sf):
    """Recipe: intro reply per search over the flagship rows, rows narrowed to mentioned models (W3 -> B6 -> U1 -> J6)."""
    from quaymind.plans.q_documents import PAIRS_SQL
    from quaymind.plans.q_recommend import diverse
    register(spark, sf)
    folds = spark.table("messages").agg(F.max("conv_id") + 1).head()[0]      # searches are dealt over all conversations
    rows = diverse(spark, sf).select("query_id", "position", "handle", "color", "spec", "condition", "price") \
        .withColumn("conv_id", F.col("query_id") % F.lit(folds)) \
        .withColumn("query", F.concat(F.lit("phones like "), F.col("query_id").cast("string")))
    out = RC.recommendation_intro(rows, spark.sql(PAIRS_SQL), _provider, model="secondary")
    return out.select("query_id", "position", "handle", "reply")


# ---- oracles for the writer / stream jobs whose results SQL can state ----------

def _echo_sql(prompt: str, model: str, *, fail_model: str = "primary", fallback: str | None = None,
              default: str | None = None, script: list[str] | None = None, answer: str | None = None) -> tuple[str, str, str]:
    """(reply, error, model_used) of U1 with the stand-in provider, in DuckDB."""
    from quaymind.plans import oracle_sql as O
    lb = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    n = f"length({prompt})"
    retry = f"({n} % 7 = 0)" if model == fail_model else "false"
    used = f"CASE WHEN {retry} AND {'true' if fallback else 'false'} THEN '{fallback or model}' ELSE '{model}' END"
    last = f"list_last(string_split_regex({O.strip(prompt)}, '{lb}'))"
    ok = O.strip(f"concat('[', {used}, '] ', {last})")
    if answer:
        ok = answer
    if script:
        ok = f"[{', '.join(repr(x) for x in script)}][{n} % {len(script)} + 1]"
    hard = f"(({retry} AND {'false' if fallback else 'true'}) OR {n} % 11 = 0)"
    err_txt = f"CASE WHEN {retry} AND {'false' if fallback else 'true'} THEN 'ProviderError: overloaded' ELSE 'ProviderError: bad request' END"
    d = "NULL" if default is None else f"'{default}'"
    blank = "''" if default is None else d
    reply = f"CASE WHEN {hard} THEN {d} WHEN {n} % 13 = 0 THEN {blank} ELSE {ok} END"
    error = f"CASE WHEN {hard} AND {'true' if default is None else 'false'} THEN {err_txt} END"
    return reply, error, used


def _attach_oracles():
    from quaymind.plans import oracle_sql as O
    from quaymind.plans.q_classify import ESC_SQL
    from quaymind.plans.q_documents import HANDLES_SQL, W4_CTES, _refine_sql
    from quaymind.plans.q_match import KB_FIRST, ROUTE_CTES
    from quaymind.plans.q_profile import ROW_HASH_SQL
    from quaymind.plans.registry import REGISTRY

    store_in = ("SELECT e.vec_id AS product_id, e.vec_id * 10 + 1 AS variant_id, c.vendor, c.product_type, c.handle, "
                "c.color, c.spec, c.condition, c.tenure, c.price FROM embeddings e LEFT JOIN catalog c "
                "ON c.product_id = e.vec_id AND c.variant_id = e.vec_id * 10 + 1")
    fp = O.sql(["catalog"], [("si", store_in), ("h", f"SELECT {ROW_HASH_SQL} AS h FROM si"),
                             ("w", "SELECT count(*) AS row_count, " + ", ".join(
                                 f"coalesce(sum(CAST(CAST(('0x' || substr(h, {1 + 16 * i}, 16)) AS UHUGEINT) AS HUGEINT)), 0) AS s{i}"
                                 for i in range(4)) + " FROM h")],
               "SELECT sha256(concat_ws(':', CAST(row_count AS VARCHAR), " + ", ".join(
                   f"CAST(s{i} % CAST('18446744073709551616' AS HUGEINT) AS VARCHAR)" for i in range(4))
               + ")) AS fingerprint, 'given-64' AS model, row_count, CAST(NULL AS BIGINT) AS \"limit\" FROM w")
    REGISTRY["a6_write_embedding_store"].oracle = fp
    REGISTRY["a7_read_embedding_store"].oracle = O.sql(["catalog"], [("si", store_in)],
                                                       "SELECT product_id, variant_id, handle, 'given-64' AS asked FROM si")
    REGISTRY["v5_build_store"].oracle = O.sql(["catalog"], [], "SELECT product_id, variant_id, 64 AS dims, handle, price FROM catalog")
    REGISTRY["v5_refresh_store"].oracle = O.sql(["catalog", "catalog_next"], [],
                                                "SELECT product_id, variant_id, 64 AS dims, handle, price FROM catalog_next")
    REGISTRY["g6_changed_since_store"].oracle = REGISTRY["g6_changed_rows"].oracle
    lb = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    last = f"list_last(string_split_regex({O.strip('prompt')}, '{lb}'))"
    REGISTRY["u1_generate_replies"].oracle = O.sql(["messages"], [
        ("p", "SELECT conv_id, turn, concat('Answer briefly.', chr(10), text) AS prompt FROM messages WHERE role = 'user'"),
        ("c", """SELECT *, length(prompt) % 7 = 0 AS retry, length(prompt) % 11 = 0 AS bad,
            length(prompt) % 13 = 0 AS blank FROM p""")], f"""
SELECT conv_id, turn, prompt,
  CASE WHEN bad THEN NULL WHEN blank THEN '' ELSE {O.strip(f"concat('[', CASE WHEN retry THEN 'secondary' ELSE 'primary' END, '] ', {last})")} END AS reply,
  CASE WHEN bad THEN 'ProviderError: bad request' END AS error,
  CASE WHEN retry THEN 'secondary' ELSE 'primary' END AS model_used
FROM c""")
    REGISTRY["u1_reply_ledger"].oracle = REGISTRY["u1_generate_replies"].oracle
    REGISTRY["t1_stream_route"].oracle = O.sql(["messages", "locations", "route_labels", "kb"], ROUTE_CTES + [
        ("esc", f"SELECT conv_id, turn, {ESC_SQL} AS r FROM messages WHERE role = 'user'")], """
SELECT r.conv_id, r.turn, coalesce(r.intercept, r.lmatch) AS match,
  CASE WHEN r.intercept IS NOT NULL THEN 1.0 ELSE r.lscore END AS score,
  CASE WHEN r.intercept IS NOT NULL THEN NULL ELSE k.ordinal END AS kb_ordinal,
  CASE WHEN r.intercept IS NOT NULL THEN r.intercept ELSE k.keyword END AS keyword,
  CASE WHEN r.intercept IS NOT NULL THEN NULL ELSE k.answer END AS answer,
  e.r <> '' AS escalate, e.r AS escalation_response
FROM routed r LEFT JOIN kbf k ON r.intercept IS NULL AND r.lmatch <> 'PRODUCT_ENQUIRE' AND lower(r.lmatch) = k.k
JOIN esc e ON e.conv_id = r.conv_id AND e.turn = r.turn""")
    REGISTRY["t2_stream_carry_query"].oracle = O.sql(["messages"], W4_CTES + [
        ("hs", HANDLES_SQL.replace("STRING", "VARCHAR")),
        ("r", f"""SELECT conv_id, turn, {_refine_sql()} AS refine,
            last_value(handles IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hs""")], """
SELECT w.conv_id, w.turn, w.eff AS effective_query,
  CASE WHEN r.refine THEN coalesce(array_to_string(r.prev, '|'), '') ELSE '' END AS preferred_handles
FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn""")
    REGISTRY["t2_stream_ordered"].oracle = REGISTRY["t2_stream_carry_query"].oracle
    reply, _, _ = _echo_sql("prompt", "primary", fallback="secondary",
                            answer="""CASE length(prompt) % 4 WHEN 0 THEN trim(ks[1]) WHEN 1 THEN trim(ks[2])
                              WHEN 2 THEN 'Logging_Ticket' ELSE 'NO_MATCH' END""")
    asked = [("ks", "SELECT list(keyword ORDER BY ordinal)[1:2] AS ks FROM kb"),
             ("p", """SELECT conv_id, turn, ks, concat('Pick a label.', chr(10), text) AS prompt
                FROM messages, ks WHERE role = 'user'"""),
             ("replies", f"SELECT conv_id, turn, coalesce({reply}, '') AS reply FROM p")]
    REGISTRY["t1_stream_model"].oracle = O.sql(["messages", "locations", "kb"], asked + ROUTE_CTES[1:] + [
        ("esc", f"SELECT conv_id, turn, {ESC_SQL} AS r FROM messages WHERE role = 'user'")], """
SELECT r.conv_id, r.turn, coalesce(r.intercept, r.lmatch) AS match,
  CASE WHEN r.intercept IS NOT NULL THEN 1.0 ELSE r.lscore END AS score,
  CASE WHEN r.intercept IS NOT NULL THEN NULL ELSE k.ordinal END AS kb_ordinal,
  CASE WHEN r.intercept IS NOT NULL THEN r.intercept ELSE k.keyword END AS keyword,
  CASE WHEN r.intercept IS NOT NULL THEN NULL ELSE k.answer END AS answer,
  e.r <> '' AS escalate, e.r AS escalation_response
FROM routed r LEFT JOIN kbf k ON r.intercept IS NULL AND r.lmatch <> 'PRODUCT_ENQUIRE' AND lower(r.lmatch) = k.k
JOIN esc e ON e.conv_id = r.conv_id AND e.turn = r.turn""")
    _ = KB_FIRST


_attach_oracles()


def _attach_recipe_oracles():
    from quaymind.plans import oracle_sql as O
    from quaymind.plans.registry import REGISTRY
    um = "SELECT conv_id, turn, text FROM messages WHERE role = 'user'"
    clean = "trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"
    ask = "concat('Reply only with JSON {\"emotion\": ...}.', chr(10), 'User message: \"', c, '\"')"
    r, _, _ = _echo_sql("prompt", "secondary", default="", script=EMOTION_SCRIPT)
    REGISTRY["u1_recipe_emotion"].oracle = O.sql(["messages"], [
        ("um", um), ("cl", f"SELECT *, {clean} AS c FROM um"), ("p", f"SELECT *, {ask} AS prompt FROM cl"),
        ("s", f"SELECT conv_id, turn, text, c, {r} AS r FROM p"),
        ("e", "SELECT *, CASE WHEN json_valid(r) THEN lower(json_extract_string(r, '$.emotion')) END AS em FROM s")], f"""
SELECT conv_id, turn, text, CASE WHEN c <> '' AND em IN ({', '.join(f"'{x}'" for x in T.EMOTIONS)}) THEN em ELSE '' END AS emotion FROM e""")
    sp = ("concat('Answer politely, then suggest a product from this list.', chr(10), chr(10), 'Products:', chr(10), "
          "'[{\"handle\": \"sample-phone\", \"price\": 1000}]', chr(10), chr(10), 'Message: \"', text, '\"')")
    r, e, u = _echo_sql("prompt", "primary")
    REGISTRY["u1_recipe_sales_redirect"].oracle = O.sql(["messages"], [("um", um), ("p", f"SELECT *, {sp} AS prompt FROM um")],
                                                        f"SELECT conv_id, turn, text, {r} AS reply, {e} AS error, {u} AS model_used FROM p")
    tr = [("h", f"SELECT conv_id, turn, {O.strip('text')} AS t FROM history WHERE {O.strip('text')} <> ''"),
          ("tr", "SELECT conv_id, array_to_string(list(t ORDER BY turn), chr(10)) AS transcript FROM h GROUP BY conv_id")]
    sprompt = ("concat('Update the summary in at most three sentences.', chr(10), chr(10), 'Previous summary:', chr(10), "
               "coalesce(concat('asked: ', q.question), ''), chr(10), chr(10), 'New messages:', chr(10), tr.transcript)")
    r, e, _ = _echo_sql("prompt", "secondary")
    REGISTRY["u1_recipe_summarise"].oracle = O.sql(["history", "questions"], tr + [
        ("p", f"SELECT q.conv_id, {sprompt} AS prompt FROM questions q JOIN tr ON tr.conv_id = q.conv_id"),
        ("kept", f"""SELECT q.conv_id, {O.strip("concat('asked: ', q.question)")} AS summary, CAST(NULL AS VARCHAR) AS error
            FROM questions q LEFT JOIN tr ON tr.conv_id = q.conv_id WHERE tr.transcript IS NULL""")],
        f"SELECT conv_id, {r} AS summary, {e} AS error FROM p UNION ALL SELECT * FROM kept")
    lines = [("h", f"SELECT conv_id, turn, {O.strip('text')} AS t FROM history WHERE {O.strip('text')} <> ''"),
             ("agg", "SELECT conv_id, list(t ORDER BY turn) AS lines FROM h GROUP BY conv_id"),
             ("tl", f"""SELECT a.conv_id, CASE WHEN {O.strip("coalesce(q.question, '')")} <> ''
                  AND lower(a.lines[len(a.lines)]) = lower({O.strip('q.question')}) THEN list_slice(a.lines, 1, len(a.lines) - 1)
                  ELSE a.lines END AS lines FROM agg a LEFT JOIN questions q USING (conv_id)"""),
             ("tr", "SELECT conv_id, CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) END AS transcript FROM tl")]
    eprompt = ("concat('Return the earlier reply that answers the question verbatim, or NO_MATCH.', chr(10), chr(10), "
               f"'Question: \"', {O.strip('q.question')}, '\"', chr(10), chr(10), 'Transcript:', chr(10), tr.transcript)")
    r, e, _ = _echo_sql("prompt", "secondary")
    rr = f"coalesce({r}, '')"
    REGISTRY["u1_recipe_earlier_reply"].oracle = O.sql(["history", "questions"], lines + [
        ("ok", f"""SELECT q.conv_id, {eprompt} AS prompt FROM questions q JOIN tr ON tr.conv_id = q.conv_id
            WHERE tr.transcript IS NOT NULL AND {O.strip("coalesce(q.question, '')")} <> ''"""),
        ("skipped", "SELECT conv_id, CAST(NULL AS VARCHAR) AS reply, CAST(NULL AS VARCHAR) AS error FROM questions "
                    "WHERE conv_id NOT IN (SELECT conv_id FROM ok)")], f"""
SELECT conv_id, CASE WHEN {O.strip(rr)} = '' OR lower({O.strip(rr)}) = 'no_match' THEN NULL ELSE {O.strip(rr)} END AS reply,
  {e} AS error FROM ok UNION ALL SELECT * FROM skipped""")


_attach_recipe_oracles()


def _attach_more_recipe_oracles():
    from quaymind.plans import oracle_sql as O
    from quaymind.plans.q_match import KB_FIRST
    from quaymind.plans.q_text import label_sql
    from quaymind.plans.registry import REGISTRY
    um = "SELECT conv_id, turn, text FROM messages WHERE role = 'user'"
    rp = ("concat('Turn the shopping request into JSON with keys search_query, recommended_model, price_min, price_max.', "
          "chr(10), 'Query: ', text)")
    r, e, _ = _echo_sql("prompt", "primary")
    REGISTRY["u1_recipe_rewrite_queries"].oracle = O.sql(["messages"], [
        ("um", um), ("p", f"SELECT *, {rp} AS prompt FROM um"),
        ("g", f"SELECT conv_id, turn, text, {r} AS reply, {e} AS err FROM p")], f"""
SELECT conv_id, turn, text, CAST(NULL AS VARCHAR) AS search_query, CAST(NULL AS VARCHAR) AS recommended_model,
  CAST(NULL AS DOUBLE) AS price_min, CAST(NULL AS DOUBLE) AS price_max,
  coalesce(err, concat('non-JSON reply: ', {O.strip("coalesce(reply, '')")})) AS error FROM g""")
    opts = (f"SELECT string_agg(concat('- ', {O.strip('keyword')}), chr(10) ORDER BY ordinal) AS o, "
            f"list(concat({O.strip('keyword')}) ORDER BY ordinal) AS ks FROM kb")
    lp = ("concat('Pick the option that answers the message, or NO_MATCH.', chr(10), chr(10), 'Options:', chr(10), "
          "opts.o, chr(10), chr(10), 'Message: ', um.text)")
    r, e, _ = _echo_sql("prompt", "primary", fallback="secondary",
                        answer="coalesce(ks[length(prompt) % (len(ks) + 1) + 1], 'NO_MATCH')")
    lab, score = label_sql("coalesce(reply, '')")
    REGISTRY["u1_recipe_label_messages"].oracle = O.sql(["messages", "kb"], [
        ("um", um), ("opts", opts), ("p", f"SELECT um.*, opts.ks, {lp} AS prompt FROM um, opts"),
        ("g", f"SELECT conv_id, turn, text, {r} AS reply, {e} AS error FROM p"),
        ("l", f"SELECT conv_id, turn, text, {lab} AS match, {score} AS score, error FROM g"),
        ("kbf", KB_FIRST)], """
SELECT l.conv_id, l.turn, l.text, l.match, l.score, l.error, f.ordinal AS kb_ordinal, f.keyword, f.answer
FROM l LEFT JOIN kbf f ON l.match <> 'PRODUCT_ENQUIRE' AND lower(l.match) = f.k""")


_attach_more_recipe_oracles()


def _attach_faq_store_oracles():
    from quaymind.plans import oracle_sql as O
    from quaymind.plans.q_classify import ALNUM, _lst
    from quaymind.plans.q_match import J8_CTES, J8_SELECT, LOC_MSG_CTES
    from quaymind.plans.recipes import DEFAULT_FAQ_REPLY
    from quaymind.plans.registry import REGISTRY
    is_faq = (f"(list_bool_or(list_transform({_lst(V['strong_faq'])}, lambda s: strpos(replace(replace(lower(text), '-', ''), ' ', ''), s) > 0))"
              f" OR len(list_intersect({ALNUM}, {_lst(V['weak_faq'])})) >= 2)")
    fp = ("concat('Answer only from the FAQ extract.', chr(10), chr(10), 'Question: \"', text, '\"', chr(10), chr(10), "
          "'FAQ extract:', chr(10), faq_text)")
    r, e, u = _echo_sql("prompt", "primary", default=DEFAULT_FAQ_REPLY)
    j8 = J8_SELECT.replace("SELECT um.conv_id, um.turn, b.section", "SELECT um.conv_id, um.turn, um.text, um.doc_id, b.section")
    REGISTRY["u1_recipe_faq_answer"].oracle = O.sql(["faq_docs", "messages"], J8_CTES + [
        ("sec", j8), ("p", f"SELECT *, {fp} AS prompt FROM sec WHERE {is_faq}")],
        f"SELECT conv_id, turn, text, doc_id, best_section, faq_text, {r} AS reply, {e} AS error, {u} AS model_used FROM p")
    lines = ("array_to_string(list_transform(list_slice(a.act, 1, 5), lambda x: concat('- ', x.n, ': ', x.l, ' | Hours: ', "
             "x.h, ' | WhatsApp: ', x.w)), chr(10))")
    block = ", chr(10), ".join(f"'{line.partition('{')[0]}', x.{field}" for line, field in zip(X.STORE_BLOCK.split("\n"), "nlhw"))
    blocks = f"array_to_string(list_transform(list_slice(a.act, 1, 5), lambda x: concat({block})), concat(chr(10), chr(10)))"
    sp = (f"concat('Reply in ', lm.language, ' listing these stores.', chr(10), chr(10), 'Message: \"', lm.text, '\"', "
          f"chr(10), chr(10), 'Stores:', chr(10), coalesce({lines}, ''))")
    r, e, u = _echo_sql("prompt", "primary", default="")
    from quaymind.plans.q_match import FIXED_REPLY_SQL, OUTCOME_SQL
    REGISTRY["u1_recipe_store_replies"].oracle = O.sql(["messages", "locations", "stores"], LOC_MSG_CTES + [
        ("p", f"""SELECT lm.conv_id, lm.turn, lm.language, lm.location_term, {sp} AS prompt, coalesce({blocks}, '') AS store_list
            FROM lm JOIN act a ON lm.conv_id = a.conv_id AND lm.turn = a.turn
            WHERE lm.location_term IS NOT NULL AND coalesce(a.n_active, 0) + coalesce(a.n_closed, 0) > 0""")], f"""
SELECT conv_id, turn, language, location_term, CASE WHEN {r} = '' THEN store_list ELSE {r} END AS reply FROM p
UNION ALL
SELECT lm.conv_id, lm.turn, lm.language, lm.location_term, {FIXED_REPLY_SQL}
FROM lm LEFT JOIN act a ON lm.conv_id = a.conv_id AND lm.turn = a.turn WHERE {OUTCOME_SQL} <> 'stores'""")


_attach_faq_store_oracles()


def _attach_intro_oracle():
    from quaymind.plans import oracle_sql as O
    from quaymind.plans.q_documents import PAIRS_SQL
    from quaymind.plans.q_recommend import DIVERSE_CTES
    from quaymind.plans.registry import REGISTRY
    r, _, _ = _echo_sql("prompt", "secondary", default="")
    ip = ("concat('Write a one-sentence intro for these options.', chr(10), chr(10), 'History:', chr(10), "
          "coalesce(m.history_text, 'None'), chr(10), chr(10), 'Query: ', c.query, chr(10), chr(10), 'Options:', chr(10), c.cat)")
    ph = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    REGISTRY["u1_recipe_recommendation_intro"].oracle = O.sql(["catalog", "messages"], DIVERSE_CTES + [
        ("rows_", "SELECT *, query_id % (SELECT max(conv_id) + 1 FROM messages) AS conv_id, concat('phones like ', CAST(query_id AS VARCHAR)) AS query FROM diverse"),
        ("cat", """SELECT query_id, conv_id, query, string_agg(concat('- ', concat_ws(' | ', handle, color, spec, condition, price)),
            chr(10) ORDER BY position) AS cat FROM rows_ GROUP BY query_id, conv_id, query"""),
        ("pairs", PAIRS_SQL),
        ("ilast3", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM pairs)
            WHERE rn <= 3 AND length(user_text) > 0 AND length(bot_text) > 0"""),
        ("iagg", """SELECT conv_id, string_agg(concat('User: ', user_text, chr(10), 'Bot: ', bot_text), chr(10) ORDER BY turn) AS h
            FROM ilast3 GROUP BY conv_id"""),
        ("mem", "SELECT DISTINCT p.conv_id, coalesce(a.h, '') AS history_text FROM pairs p LEFT JOIN iagg a USING (conv_id)"),
        ("ip", f"SELECT c.query_id, {ip} AS prompt FROM cat c LEFT JOIN mem m ON m.conv_id = c.conv_id"),
        ("rep", f"SELECT query_id, {r} AS reply FROM ip"),
        ("mm", f"""SELECT r.query_id, r.position, r.handle, rep.reply,
            coalesce({ph.format(x="rep.reply")} <> '' AND {ph.format(x=O.blank('r.handle'))} <> ''
              AND strpos({ph.format(x="rep.reply")}, {ph.format(x=O.blank('r.handle'))}) > 0, false) AS m
            FROM rows_ r LEFT JOIN rep USING (query_id)"""),
        ("fm", "SELECT query_id, bool_or(m) AS anym FROM mm GROUP BY query_id")], """
SELECT mm.query_id, mm.position, mm.handle, mm.reply FROM mm JOIN fm USING (query_id) WHERE mm.m OR NOT fm.anym""")


_attach_intro_oracle()
