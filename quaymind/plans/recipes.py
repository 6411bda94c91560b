"""Model-backed recipes: prompt (B6) -> batch model call (U1) -> clean-up.

Each recipe is a plain composition of the operators; prompt wording is a
caller parameter (the defaults here are our own neutral templates).  The
provider is any factory accepted by :func:`generate_replies`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymind.functions import text as T
from quaymind.functions.vocab import check_literal
from quaymind.operators import classify as C
from quaymind.operators import documents as D
from quaymind.operators import match as M
from quaymind.operators import project as P
from quaymind.operators import recommend as R
from quaymind.operators.flow import recommend
from quaymind.operators.infer import generate_replies
from quaymind.operators.vectors import encode_texts
from quaymind.session import checkpoint_dir

Provider = Callable[[], object]

DEFAULT_FAQ_REPLY = "Sorry, the answer is not available right now. Please contact support."
DEFAULT_STORE_REPLY = ""


def rewrite_search_queries(queries: DataFrame, provider: Provider, *, model: str, allowed: DataFrame | None = None,
                           text: str = "text", fallback_model: str | None = None) -> DataFrame:
    """Query rewrite: B6 -> U1 -> C12 -> S4.  Unparsable replies keep an
    ``error`` value instead of failing the job."""
    prompt = P.assemble_prompts(queries, [
        "Turn the shopping request into JSON with keys search_query, recommended_model, price_min, price_max.\n",
        "Query: ", F.col(text)])
    out = generate_replies(prompt, "prompt", provider, model=model, fallback_model=fallback_model)
    plan = T.parse_query_plan(F.coalesce(F.col("reply"), F.lit("")), F.col(text))
    out = out.select(*queries.columns, plan["search_query"].alias("search_query"),
                     plan["recommended_model"].alias("recommended_model"), plan["price_min"].alias("price_min"),
                     plan["price_max"].alias("price_max"),
                     F.coalesce(F.col("error"), plan["error"]).alias("error"))
    return R.constrain_model(out, "recommended_model", allowed)


def effective_query(search_query, recommended_model):
    """What is searched for: the recommended model, if any, in front of the rewritten query."""
    m, q = F.coalesce(recommended_model, F.lit("")), F.coalesce(search_query, F.lit(""))
    return F.when(m != "", T.py_strip(F.concat(m, F.lit(" "), q))).otherwise(q)


def recommend_messages(messages: DataFrame, corpus: DataFrame, catalog: DataFrame, provider: Provider, *, model: str,
                       stopwords: list[str], allowed: DataFrame | None = None, encoder_factory=None,
                       message_id: str = "message_id", text: str = "text", summary: str | None = None,
                       fallback_model: str | None = None, **options) -> DataFrame:
    """V4 from text: query rewrite (B6 -> U1 -> C12 -> S4) -> V1 -> V4, one answer per message.

    ``message_id`` is a unique long.  A ``summary`` column is put behind the
    text as context.  A message whose rewrite fails is searched by its own
    text without price bounds and keeps the ``error``; a blank effective
    query has a null vector and gets the no-match message.  ``options`` go to
    :func:`recommend`.

    Plans and vectors are written to the shared folder before the search: the
    flow reads its queries several times, and the model is asked only once.
    """
    asked = F.coalesce(F.col(text), F.lit(""))
    if summary:
        context = F.coalesce(F.col(summary), F.lit(""))
        asked = F.when(context != "", F.concat(asked, F.lit("\n\nContext: "), context)).otherwise(asked)
    plans = rewrite_search_queries(messages.select(F.col(message_id).cast("long").alias("query_id"), asked.alias("asked")),
                                   provider, model=model, allowed=allowed, text="asked", fallback_model=fallback_model)
    failed = F.col("error").isNotNull()
    plans = plans.select(
        "query_id", "error", F.when(failed, F.col("asked")).otherwise(
            effective_query(F.col("search_query"), F.col("recommended_model"))).alias("effective_query"),
        *[F.when(~failed, F.col(c)).alias(n) for c, n in
          (("recommended_model", "model"), ("price_min", "price_min"), ("price_max", "price_max"))])
    path = f"{checkpoint_dir(messages.sparkSession)}/quaymind/message-plans-{uuid.uuid4().hex}"
    encode_texts(plans, "effective_query", encoder_factory=encoder_factory) \
        .withColumn("embedding", F.when(T.py_strip("effective_query") != "", F.col("embedding"))).write.parquet(path)
    queries = messages.sparkSession.read.parquet(path)
    answers = recommend(queries, corpus, catalog, stopwords=stopwords, **options)
    return queries.select("query_id", "effective_query", "error").join(answers, "query_id").withColumnRenamed("query_id", message_id)


def label_messages(messages: DataFrame, kb: DataFrame, provider: Provider, *, model: str,
                   text: str = "text", summary: str | None = None, fallback_model: str | None = None) -> DataFrame:
    """Knowledge-base labelling: B6 (options = all trimmed keywords, a
    size-checked dimension list) -> U1 -> C13 -> J3."""
    check_literal(kb, "keyword", "the knowledge base's keyword list")
    rows = kb.select("ordinal", T.py_strip(F.col("keyword")).alias("k")).orderBy("ordinal").collect()
    options = "\n".join(f"- {r['k']}" for r in rows)   # bounded option list, one literal for all prompts
    m = messages.withColumn("_options", F.lit(options))
    parts = ["Pick the option that answers the message, or NO_MATCH.\n\nOptions:\n", F.col("_options"),
             "\n\nMessage: ", F.col(text)]
    if summary:
        parts += [("optional", "\n\nConversation summary: ", F.col(summary), "")]
    out = generate_replies(P.assemble_prompts(m, parts), "prompt", provider, model=model, fallback_model=fallback_model)
    lab = T.normalize_label(F.coalesce(F.col("reply"), F.lit("")))
    out = out.select(*messages.columns, lab["match"].alias("match"), lab["score"].alias("score"), "error")
    return M.kb_match(out, kb)


def answer_from_faq(messages: DataFrame, keyword_map: DataFrame, sections: DataFrame, provider: Provider, *,
                    model: str, strong: list[str], weak: list[str], text: str = "text",
                    default_text: str = DEFAULT_FAQ_REPLY) -> DataFrame:
    """FAQ answers: P5 -> J8 -> B6 -> U1 with a default reply on failure."""
    faq = messages.filter(C.is_faq_query(text, strong, weak))
    sec = M.faq_section(faq, keyword_map, sections, text=text)
    prompt = P.assemble_prompts(sec, ["Answer only from the FAQ extract.\n\nQuestion: \"", F.col(text),
                                      "\"\n\nFAQ extract:\n", F.col("faq_text")])
    return generate_replies(prompt, "prompt", provider, model=model, default_text=default_text)


def store_replies(messages: DataFrame, dictionary: DataFrame, stores: DataFrame, provider: Provider, *,
                  model: str, malay: list[str], ranked_terms, keys: list[str] | None = None,
                  text: str = "text", fixed_replies: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Store replies: P12 -> B6 -> U1, falling back to the plain store list
    (B7) when the model gives nothing.  Messages without a place and places
    without a store get their fixed reply and make no model call."""
    outc = M.store_outcome(messages, dictionary, stores, malay, ranked_terms, keys=keys, text=text, replies=fixed_replies)
    withs = P.render_store_list(outc.filter(F.col("outcome") == "stores").drop("reply")) \
        .withColumn("store_lines", P.store_lines())
    prompt = P.assemble_prompts(withs, ["Reply in ", F.col("language"), " listing these stores.\n\nMessage: \"",
                                        F.col(text), "\"\n\nStores:\n", F.col("store_lines")])
    out = generate_replies(prompt, "prompt", provider, model=model, default_text="")
    out = out.withColumn("reply", F.when(F.col("reply") == "", F.col("store_list")).otherwise(F.col("reply")))
    return out.unionByName(outc.filter(F.col("outcome") != "stores"), allowMissingColumns=True)


def summarise_conversations(turns: DataFrame, previous: DataFrame, provider: Provider, *, model: str,
                            conv: str = "conv_id") -> DataFrame:
    """Summaries: G9 transcript -> B6 -> U1; a conversation without turns
    keeps its previous summary and makes no model call."""
    tr = D.transcript(turns, conv=conv)
    df = previous.join(tr, conv, "full")
    has = df.filter(F.col("transcript").isNotNull())
    prompt = P.assemble_prompts(has, ["Update the summary in at most three sentences.\n\nPrevious summary:\n",
                                      F.coalesce(F.col("previous_summary"), F.lit("")),
                                      "\n\nNew messages:\n", F.col("transcript")])
    called = generate_replies(prompt, "prompt", provider, model=model).select(conv, F.col("reply").alias("summary"), "error")
    kept = df.filter(F.col("transcript").isNull()).select(conv, T.py_strip(F.coalesce("previous_summary", F.lit(""))).alias("summary"),
                                                         F.lit(None).cast("string").alias("error"))
    return called.unionByName(kept)


def find_earlier_reply(turns: DataFrame, questions: DataFrame, provider: Provider, *, model: str,
                       conv: str = "conv_id") -> DataFrame:
    """Earlier reply: G9 (trailing copy of the question dropped) -> B6 -> U1
    -> C15; no call when there is no transcript or question."""
    tr = D.transcript(turns, conv=conv, questions=questions)
    q = questions.join(tr, conv, "left")
    ok = q.filter(F.col("transcript").isNotNull() & (T.py_strip(F.coalesce("question", F.lit(""))) != ""))
    prompt = P.assemble_prompts(ok, ["Return the earlier reply that answers the question verbatim, or NO_MATCH.\n\n",
                                     "Question: \"", T.py_strip(F.col("question")), "\"\n\nTranscript:\n", F.col("transcript")])
    out = generate_replies(prompt, "prompt", provider, model=model)
    called = out.select(conv, T.normalize_history_reply(F.coalesce("reply", F.lit(""))).alias("reply"), "error")
    skipped = q.join(ok.select(conv), conv, "left_anti").select(
        conv, F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"))
    return called.unionByName(skipped)


def label_emotion(messages: DataFrame, provider: Provider, *, model: str, text: str = "text") -> DataFrame:
    """Emotion: C11 -> B6 -> U1 -> C14; blank text gives '' without a call."""
    m = messages.withColumn("_clean", T.collapse_ws(F.col(text)))
    blank = m.filter(F.col("_clean") == "").withColumn("emotion", F.lit("")).drop("_clean")
    todo = P.assemble_prompts(m.filter(F.col("_clean") != ""),
                              ["Reply only with JSON {\"emotion\": ...}.\nUser message: \"", F.col("_clean"), "\""])
    out = generate_replies(todo, "prompt", provider, model=model, default_text="")
    out = out.withColumn("emotion", T.normalize_emotion(F.col("reply"))).select(*messages.columns, "emotion")
    return out.unionByName(blank)


def sales_redirect(messages: DataFrame, product_json: str, provider: Provider, *, model: str,
                   text: str = "text") -> DataFrame:
    """Sales redirect reply: B6 -> U1."""
    prompt = P.assemble_prompts(messages, ["Answer politely, then suggest a product from this list.\n\nProducts:\n",
                                           product_json, "\n\nMessage: \"", F.col(text), "\""])
    return generate_replies(prompt, "prompt", provider, model=model)


def stock_query_prompt(messages: DataFrame, profile_text: str | None, *, given: str | None = None,
                       default_ddl: str = "", text: str = "text") -> DataFrame:
    """Stock-query prompt (no model call): the table profile (G4) when
    available, else the caller's text, else a default DDL."""
    schema = profile_text or given or default_ddl
    return P.assemble_prompts(messages, ["Write one read-only SQL query for the request.\n\nTable:\n", schema,
                                         "\n\nRequest: ", F.col(text)])


def recommendation_intro(rows: DataFrame, pairs: DataFrame, provider: Provider, *, model: str,
                         query_id: str = "query_id", conv: str = "conv_id") -> DataFrame:
    """Recommendation intro: W3 memory -> B6 -> U1 -> J6 (rows narrowed to
    the models the reply mentions).  ``rows`` carry ``conv_id`` and the
    user ``query`` text per ``query_id``.

    The rows are written to the shared folder first: prompts and answers both
    read them, and what finds them (a search) runs once."""
    path = f"{checkpoint_dir(rows.sparkSession)}/quaymind/intro-rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    mem = D.last_turns(pairs, conv=conv)
    cat = rows.groupBy(query_id, conv, "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "position", F.concat_ws(" | ", "handle", "color", "spec", "condition", "price").alias("l")))),
        lambda x: F.concat(F.lit("- "), x["l"])), "\n").alias("_catalog"))
    p = cat.join(mem, conv, "left")
    prompt = P.assemble_prompts(p, ["Write a one-sentence intro for these options.\n\nHistory:\n",
                                    F.coalesce(F.col("history_text"), F.lit("None")), "\n\nQuery: ", F.col("query"),
                                    "\n\nOptions:\n", F.col("_catalog")])
    replies = generate_replies(prompt, "prompt", provider, model=model, default_text="").select(query_id, "reply")
    return R.semi_or_all_by_mention(rows.join(replies, query_id, "left"), "reply", query_id=query_id)
