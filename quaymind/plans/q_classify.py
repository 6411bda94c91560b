"""Classifier jobs (P1-P10, P13) over whole fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymind.functions import text as T
from quaymind.functions.vocab import terms
from quaymind.operators import classify as C
from quaymind.operators import recommend as R
from quaymind.plans import oracle_sql as O
from quaymind.plans.registry import query
from quaymind.sources.fixtures import VOCABULARIES, register, vocab_df

V = VOCABULARIES


def _lst(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _vocab(spark, name):
    return terms(vocab_df(spark, [name]), name)


def _ranked(spark):
    return C._ranked_terms(spark.table("locations"))


WORDS = O.ordered_unique("regexp_extract_all(lower(text), '[a-z]+')")
ALNUM = O.ordered_unique("regexp_extract_all(lower(text), '[a-z0-9]+')")
LOCATION_SUBQ = """(SELECT l.term FROM locations l
  WHERE regexp_matches(lower(m.text), concat('(^|[^\\p{L}\\p{N}_])', l.term, '($|[^\\p{L}\\p{N}_])'))
  ORDER BY length(l.term) DESC, l.ordinal LIMIT 1)"""


@query("p1_price_filter", O.sql(["catalog"], [], f"""
SELECT product_id, price FROM (SELECT product_id, price, {O.parse_price('price')} AS p FROM catalog)
WHERE p IS NULL OR (p >= 2750.0 AND p < 2950.0)"""))
def p1(spark, sf):
    """P1 half-open price filter over the whole catalog (text prices parsed)."""
    register(spark, sf)
    return R.price_filter(spark.table("catalog"), "price", 2750.0, 2950.0).select("product_id", "price")


@query("p2_detect_language", O.sql(["messages"], [], f"""
SELECT conv_id, turn, CASE WHEN len(list_intersect({WORDS}, {_lst(V['malay'])})) >= 2 THEN 'ms' ELSE 'en' END AS language
FROM messages"""))
def p2(spark, sf):
    """P2 language of every message."""
    register(spark, sf)
    return spark.table("messages").select("conv_id", "turn",
                                          C.detect_language("text", _vocab(spark, "malay")).alias("language"))


@query("p3_detect_location", O.sql(["messages", "locations"], [], f"""
SELECT m.conv_id, m.turn, {LOCATION_SUBQ} AS location_term FROM messages m"""))
def p3(spark, sf):
    """P3 longest dictionary term on word boundaries in every message."""
    register(spark, sf)
    return C.detect_location(spark.table("messages"), "text", spark.table("locations")) \
        .select("conv_id", "turn", "location_term")


@query("p4_is_location_query", O.sql(["messages", "locations"], [], f"""
SELECT conv_id, turn, (list_has_any(w, {_lst(V['strong_location'])}) OR len(list_intersect(w, {_lst(V['weak_location'])})) >= 2
  OR (len(w) <= 6 AND loc IS NOT NULL)) AS is_location
FROM (SELECT m.conv_id, m.turn, {WORDS.replace('text', 'm.text')} AS w, {LOCATION_SUBQ} AS loc FROM messages m)"""))
def p4(spark, sf):
    """P4 location-question flag of every message."""
    register(spark, sf)
    e = C.is_location_query("text", _vocab(spark, "strong_location"), _vocab(spark, "weak_location"), _ranked(spark))
    return spark.table("messages").select("conv_id", "turn", e.alias("is_location"))


@query("p5_is_faq_query", O.sql(["messages"], [], f"""
SELECT conv_id, turn, (list_bool_or(list_transform({_lst(V['strong_faq'])},
    lambda s: strpos(replace(replace(lower(text), '-', ''), ' ', ''), s) > 0))
  OR len(list_intersect({ALNUM}, {_lst(V['weak_faq'])})) >= 2) AS is_faq FROM messages"""))
def p5(spark, sf):
    """P5 FAQ-question flag of every message."""
    register(spark, sf)
    e = C.is_faq_query("text", _vocab(spark, "strong_faq"), _vocab(spark, "weak_faq"))
    return spark.table("messages").select("conv_id", "turn", e.alias("is_faq"))


def _any_sub(words, t="lower(text)"):
    return f"list_bool_or(list_transform({_lst(words)}, lambda w: strpos({t}, w) > 0))"


ESC_SQL = f"""CASE
  WHEN list_bool_or(list_transform({_lst(V['greeting'])}, lambda g: lower(text) = g OR starts_with(lower(text), concat(g, ' '))))
    THEN 'How can I help you today?'
  WHEN {_any_sub(V['ticket_logged'])} THEN 'TICKET_LOGGED'
  WHEN {_any_sub(V['human'])} THEN 'log_ticket'
  WHEN {_any_sub(V['ticket'])} THEN 'log_ticket'
  ELSE '' END"""


@query("p6_detect_escalation", O.sql(["messages"], [], f"""
SELECT conv_id, turn, response <> '' AS escalate, response FROM (SELECT conv_id, turn, {ESC_SQL} AS response FROM messages)"""))
def p6(spark, sf):
    """P6 escalation decision of every message."""
    register(spark, sf)
    e = C.detect_escalation("text", _vocab(spark, "greeting"), _vocab(spark, "ticket_logged"),
                            _vocab(spark, "human"), _vocab(spark, "ticket"))
    return spark.table("messages").select("conv_id", "turn", e["escalate"].alias("escalate"),
                                          e["response"].alias("response"))


@query("p7_is_refinement", O.sql(["messages"], [], f"""
SELECT conv_id, turn, CASE WHEN len({O.tokens('text')}) = 0 THEN false
  ELSE {_any_sub(V['refinement'])} OR len({O.tokens('text')}) <= 4 END AS is_refinement FROM messages"""))
def p7(spark, sf):
    """P7 refinement flag of every message."""
    register(spark, sf)
    return spark.table("messages").select("conv_id", "turn",
                                          C.is_refinement("text", _vocab(spark, "refinement")).alias("is_refinement"))


MODEL_TEXT_SQL = """CASE product_id % 5
  WHEN 0 THEN replace(handle, '-', ' ')
  WHEN 1 THEN concat(replace(handle, '-', ' '), ' 12')
  WHEN 2 THEN concat('any ', color, ' phone 5 pro max')
  WHEN 3 THEN concat('do you have ', color, ' ', spec)
  ELSE concat(replace(handle, '-', ' '), ' ', split_part(handle, '-', 1), ' x series') END"""


def p8_sql(model: str, handle: str) -> str:
    mt = O.ordered_unique(f"list_filter({O.tokens(model)}, lambda t: NOT list_contains({_lst(V['stopwords'])}, t))")
    ht = O.tokens(f"lower({O.blank(handle)})")
    return f"""(SELECT len(ht) > 0 AND len(mt) > 0
      AND len(list_filter(mt, lambda t: regexp_matches(t, '^[0-9]+$') AND NOT list_contains(ht, t))) = 0
      AND CASE WHEN len(mt) <= 3 THEN len(list_filter(mt, lambda t: list_contains(ht, t))) = len(mt)
          ELSE len(list_filter(mt, lambda t: list_contains(ht, t))) >= greatest(2, CAST(floor((len(mt) * 3 + 3) / 4) AS BIGINT)) END
      FROM (SELECT {mt} AS mt, {ht} AS ht))"""


@query("p8_handle_matches_model", O.sql(["catalog"], [], f"""
SELECT product_id, model, {p8_sql('model', 'handle')} AS matches
FROM (SELECT product_id, handle, {MODEL_TEXT_SQL} AS model FROM catalog)"""))
def p8(spark, sf):
    """P8 model-name vs handle test for every catalog row."""
    register(spark, sf)
    df = spark.table("catalog").withColumn("model", F.expr(MODEL_TEXT_SQL))
    mt = T.model_tokens(F.coalesce(F.col("model"), F.lit("")), V["stopwords"])
    return df.select("product_id", "model",
                     R.handle_matches_model(mt, F.lower(T.str_or_blank("handle"))).alias("matches"))


@query("p9_prefix_ilike", O.sql(["catalog"], [], """
SELECT product_id, handle FROM catalog WHERE handle ILIKE 'bLu%'"""))
def p9(spark, sf):
    """P9 case-insensitive handle prefix over the whole catalog."""
    register(spark, sf)
    c = spark.table("catalog")
    return c.filter(R.prefix_ilike(F.col("handle"), "bLu")).select("product_id", "handle")


@query("p10_split_open_closed", O.sql(["stores"], [], """
SELECT id, name, strpos(lower(name), 'temporarily closed') > 0 AS closed FROM stores"""))
def p10(spark, sf):
    """P10 open/closed flag of every store."""
    register(spark, sf)
    return spark.table("stores").select("id", "name", C.is_closed("name").alias("closed"))


@query("p13_split_valid", O.sql(["messages"], [], f"""
SELECT conv_id, turn, CASE WHEN q IS NULL OR {O.strip('q')} = '' THEN 'Question cannot be empty.' END AS reject_reason
FROM (SELECT conv_id, turn, CASE WHEN turn % 9 = 4 THEN '  ' WHEN turn % 9 = 7 THEN NULL ELSE text END AS q FROM messages)"""))
def p13(spark, sf):
    """P13 request validation of every message (blank/NULL payloads injected)."""
    register(spark, sf)
    q = F.when(F.col("turn") % 9 == 4, F.lit("  ")).when(F.col("turn") % 9 == 7, F.lit(None)).otherwise(F.col("text"))
    return spark.table("messages").select("conv_id", "turn", C.validation_reason(q).alias("reject_reason"))
