"""Scalar text functions (C1-C17) applied to whole fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymind.functions import text as T
from quaymind.plans import oracle_sql as O
from quaymind.plans.registry import query
from quaymind.sources.fixtures import VOCABULARIES, register

STOP = VOCABULARIES["stopwords"]


def _msgs(spark, sf):
    register(spark, sf)
    return spark.table("messages")


def _stop_sql():
    return "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query("c1_tokens", O.sql(["messages"], [], f"""
SELECT conv_id, turn, array_to_string({O.tokens('text')}, '|') AS tokens FROM messages"""))
def c1(spark, sf):
    """C1 tokens of every message."""
    return _msgs(spark, sf).select("conv_id", "turn", F.array_join(T.tokens("text"), "|").alias("tokens"))


@query("c2_keywords", O.sql(["messages"], [], f"""
SELECT conv_id, turn, array_to_string({O.ordered_unique("list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: length(t) > 2)")}, '|') AS keywords
FROM messages"""))
def c2(spark, sf):
    """C2 keyword sets of every message (first-seen order)."""
    return _msgs(spark, sf).select("conv_id", "turn", F.array_join(T.keywords("text"), "|").alias("keywords"))


@query("c3_word_set", O.sql(["messages"], [], f"""
SELECT conv_id, turn,
  array_to_string({O.ordered_unique("regexp_extract_all(lower(text), '[a-z]+')")}, '|') AS words,
  array_to_string({O.ordered_unique("regexp_extract_all(lower(text), '[a-z0-9]+')")}, '|') AS alnum_words
FROM messages"""))
def c3(spark, sf):
    """C3 distinct letter words and alphanumeric words of every message."""
    return _msgs(spark, sf).select("conv_id", "turn", F.array_join(T.word_set("text"), "|").alias("words"),
                                   F.array_join(T.alnum_word_set("text"), "|").alias("alnum_words"))


@query("c4_model_tokens", O.sql(["messages"], [], f"""
SELECT conv_id, turn,
  array_to_string({O.ordered_unique(f"list_filter({O.tokens('text')}, lambda t: NOT list_contains({_stop_sql()}, t))")}, '|') AS model_tokens
FROM messages"""))
def c4(spark, sf):
    """C4 model tokens (stopwords removed, first-seen, no repeats)."""
    return _msgs(spark, sf).select("conv_id", "turn",
                                   F.array_join(T.model_tokens("text", STOP), "|").alias("model_tokens"))


@query("c5_parse_price", O.sql(["catalog", "messages"], [], f"""
SELECT 'catalog' AS src, product_id AS id, {O.parse_price('price')} AS price_value FROM catalog
UNION ALL
SELECT 'message' AS src, conv_id * 1000 + turn AS id, {O.parse_price('text')} AS price_value FROM messages"""))
def c5(spark, sf):
    """C5 price parsing of catalog prices and free message text."""
    register(spark, sf)
    cat = spark.table("catalog").select(F.lit("catalog").alias("src"), F.col("product_id").alias("id"),
                                        T.parse_price("price").alias("price_value"))
    msg = spark.table("messages").select(F.lit("message").alias("src"),
                                         (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                         T.parse_price("text").alias("price_value"))
    return cat.unionByName(msg)


@query("c6_storage_key", O.sql(["catalog"], [], f"""
SELECT product_id, {O.storage_gb('spec')} AS gb, lower({O.blank('spec')}) AS spec_key FROM catalog"""))
def c6(spark, sf):
    """C6 storage ordering key of every catalog spec."""
    register(spark, sf)
    k = T.storage_key("spec")
    return spark.table("catalog").select("product_id", k["gb"].alias("gb"), k["text"].alias("spec_key"))


@query("c7_pretty_handle", O.sql(["catalog"], [], f"""
SELECT product_id, CASE WHEN {O.blank('handle')} = '' THEN 'Unknown model' ELSE array_to_string(list_transform(
  string_split(regexp_replace({O.blank('handle')}, '-flash-deal$', ''), '-'),
  lambda p: concat(upper(left(p, 1)), lower(substr(p, 2)))), ' ') END AS title FROM catalog"""))
def c7(spark, sf):
    """C7 display title of every catalog handle."""
    register(spark, sf)
    return spark.table("catalog").select("product_id", T.pretty_handle("handle").alias("title"))


@query("c8_format_price", O.sql(["catalog"], [], f"""
SELECT product_id, CASE WHEN p IS NULL THEN '-' WHEN p = floor(p) THEN concat('RM', format('{{:,}}', CAST(p AS BIGINT)))
  ELSE concat('RM', format('{{:,.2f}}', p)) END AS price_text
FROM (SELECT product_id, {O.parse_price('price')} AS p FROM catalog)"""))
def c8(spark, sf):
    """C8 price display text of every catalog row."""
    register(spark, sf)
    return spark.table("catalog").select("product_id", T.format_price("price").alias("price_text"))


@query("c9_compact_values", O.sql(["messages"], [], f"""
SELECT conv_id, turn, CASE WHEN len(v) = 0 THEN '-' ELSE array_to_string(v, ' / ') END AS compact FROM (
  SELECT conv_id, turn, {O.ordered_unique(f"list_filter(list_transform(string_split(text, ' '), lambda w: {O.blank('w')}), lambda w: w <> '' AND lower(w) <> 'none')")} AS v
  FROM messages)"""))
def c9(spark, sf):
    """C9 compacted word lists of every message."""
    return _msgs(spark, sf).select("conv_id", "turn",
                                   T.compact_values(F.split("text", " ")).alias("compact"))


@query("c10_phrase", O.sql(["messages"], [], """
SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM messages"""))
def c10(spark, sf):
    """C10 normalised phrase of every message."""
    return _msgs(spark, sf).select("conv_id", "turn", T.phrase("text").alias("phrase"))


@query("c11_collapse_ws", O.sql(["messages"], [], f"""
SELECT conv_id, turn, trim(regexp_replace(text, '{O.WS}+', ' ', 'g')) AS collapsed FROM messages"""))
def c11(spark, sf):
    """C11 whitespace-collapsed text of every message."""
    return _msgs(spark, sf).select("conv_id", "turn", T.collapse_ws("text").alias("collapsed"))


PLAN_REPLIES_SQL = """
SELECT conv_id, turn, text AS query,
  CASE (conv_id + turn) % 7
    WHEN 0 THEN concat('{"search_query": "', split_part(text, ' ', 1), ' phone", "recommended_model": "',
                       split_part(text, ' ', 2), '", "price_min": 1000, "price_max": 3000}')
    WHEN 1 THEN concat('```json', chr(10), '{"search_query": "budget phones", "price_max": "2,500"}', chr(10), '```')
    WHEN 2 THEN '{"search_query": "", "price_min": "1,200", "price_max": "abc"}'
    WHEN 3 THEN '{}'
    WHEN 4 THEN '{"recommended_model": 42, "search_query": "x", "price_min": true}'
    WHEN 5 THEN '{"search_query": null}'
    ELSE 'sorry, I cannot help with that' END AS reply
FROM messages WHERE role = 'user'
"""


@query("c12_parse_query_plan")
def c12(spark, sf):
    """C12 query-rewrite reply parsing (JSON kinds, fences, bad JSON as error rows)."""
    register(spark, sf)
    r = spark.sql(PLAN_REPLIES_SQL)
    p = T.parse_query_plan(F.col("reply"), F.col("query"))
    return r.select("conv_id", "turn", p["search_query"].alias("search_query"),
                    p["recommended_model"].alias("recommended_model"), p["price_min"].alias("price_min"),
                    p["price_max"].alias("price_max"), p["error"].alias("error"))


def _label_replies_spark(spark):
    return spark.sql("""
SELECT conv_id, turn, CASE (conv_id + turn) % 5
    WHEN 0 THEN label
    WHEN 1 THEN to_json(named_struct('match', label, 'score', 0.75D))
    WHEN 2 THEN '  Logging_Ticket '
    WHEN 3 THEN 'ticket_LOGGED'
    ELSE '{"score": 0.5}' END AS reply
FROM route_labels""")


LABEL_REPLIES_DUCK = """
SELECT conv_id, turn, CASE (conv_id + turn) % 5
    WHEN 0 THEN label
    WHEN 1 THEN CAST(to_json({'match': label, 'score': 0.75::DOUBLE}) AS VARCHAR)
    WHEN 2 THEN '  Logging_Ticket '
    WHEN 3 THEN 'ticket_LOGGED'
    ELSE '{"score": 0.5}' END AS reply
FROM route_labels"""


def label_sql(reply: str) -> tuple[str, str]:
    """(match, score) of C13 in DuckDB."""
    st = O.strip(reply)
    js = f"(CASE WHEN coalesce(json_valid({st}), false) THEN {st} ELSE 'null' END)"
    is_obj = f"(json_type({js}) = 'OBJECT')"
    m = O.strip(f"CASE WHEN {is_obj} THEN coalesce(json_extract_string({js}, '$.match'), 'NO_MATCH') ELSE {reply} END")
    score = f"CASE WHEN {is_obj} THEN coalesce(TRY_CAST(json_extract({js}, '$.score') AS DOUBLE), 0.0) ELSE 0.0 END"
    lab = (f"CASE WHEN upper({m}) = 'TICKET_LOGGED' THEN 'TICKET_LOGGED' "
           f"WHEN upper({m}) IN ('LOGGING_TICKET', 'LOG_TICKET') THEN 'log_ticket' ELSE {m} END")
    return lab, score


_lab, _score = label_sql("reply")


@query("c13_normalize_label", O.sql(["route_labels"], [("replies", LABEL_REPLIES_DUCK)], f"""
SELECT conv_id, turn, {_lab} AS match, {_score} AS score FROM replies"""))
def c13(spark, sf):
    """C13 routing-model reply -> (match, score)."""
    register(spark, sf)
    n = T.normalize_label(F.col("reply"))
    return _label_replies_spark(spark).select("conv_id", "turn", n["match"].alias("match"), n["score"].alias("score"))


EMOTION_REPLIES = """
SELECT conv_id, turn, CASE (conv_id + turn) % 7
    WHEN 0 THEN '{"emotion": "Frustrated"}'
    WHEN 1 THEN '{"emotion": "happy"}'
    WHEN 2 THEN 'not json at all'
    WHEN 3 THEN '{"emotion": 3}'
    WHEN 4 THEN '{"mood": "sad"}'
    WHEN 5 THEN '["sad"]'
    ELSE '{"emotion": "WORRIED", "x": 1}' END AS reply
FROM messages"""


@query("c14_normalize_emotion", O.sql(["messages"], [("replies", EMOTION_REPLIES)], """
SELECT conv_id, turn, CASE WHEN e IN ('frustrated', 'worried', 'confused', 'sad') THEN e ELSE '' END AS emotion
FROM (SELECT conv_id, turn, CASE WHEN json_type(js) = 'OBJECT' THEN lower(json_extract_string(js, '$.emotion')) END AS e
      FROM (SELECT *, CASE WHEN coalesce(json_valid(reply), false) THEN reply ELSE 'null' END AS js FROM replies))"""))
def c14(spark, sf):
    """C14 emotion-model reply -> whitelisted emotion or ''."""
    register(spark, sf)
    return spark.sql(EMOTION_REPLIES).select("conv_id", "turn", T.normalize_emotion("reply").alias("emotion"))


@query("c15_normalize_history_reply", O.sql(["route_labels"], [], f"""
SELECT conv_id, turn, CASE WHEN {O.strip('label')} = '' OR lower({O.strip('label')}) = 'no_match' THEN NULL
  ELSE {O.strip('label')} END AS reply FROM route_labels"""))
def c15(spark, sf):
    """C15 history-model reply clean-up (blank / no_match -> NULL)."""
    register(spark, sf)
    return spark.table("route_labels").select("conv_id", "turn", T.normalize_history_reply("label").alias("reply"))


@query("c16_split_table_name", O.sql([], [], """
SELECT page_id AS id, CASE WHEN strpos(url, '.') > 0 THEN split_part(url, '.', 1) ELSE 'public' END AS schema_name,
  CASE WHEN strpos(url, '.') > 0 THEN substr(url, strpos(url, '.') + 1) ELSE url END AS table_name FROM pages
UNION ALL
SELECT -1 - item_id AS id, CASE WHEN strpos(t, '.') > 0 THEN split_part(t, '.', 1) ELSE 'public' END,
  CASE WHEN strpos(t, '.') > 0 THEN substr(t, strpos(t, '.') + 1) ELSE t END
FROM (SELECT item_id, split_part(text, ' ', 1) AS t FROM benchmark)"""))
def c16(spark, sf):
    """C16 'schema.table' split of page URLs and first words."""
    register(spark, sf)
    p = spark.table("pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    b = spark.table("benchmark").select((F.lit(-1) - F.col("item_id")).alias("id"),
                                        F.split_part("text", F.lit(" "), F.lit(1)).alias("name"))
    s = T.split_table_name(F.col("name"))
    return p.unionByName(b).select("id", s["schema"].alias("schema_name"), s["table"].alias("table_name"))


@query("c17_price_line", O.sql([], [], """
SELECT vec_id AS query_id, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN concat(CAST(lo AS VARCHAR), ' to ', CAST(hi AS VARCHAR))
  WHEN lo IS NOT NULL THEN concat('min ', CAST(lo AS VARCHAR)) WHEN hi IS NOT NULL THEN concat('max ', CAST(hi AS VARCHAR))
  ELSE 'None' END AS price_line
FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 2750.0::DOUBLE END AS lo,
             CASE WHEN vec_id % 2 = 0 THEN 2950.5::DOUBLE ELSE NULL END AS hi FROM embeddings)"""))
def c17(spark, sf):
    """C17 price line of every search's bounds."""
    register(spark, sf)
    e = spark.table("embeddings")
    lo = F.when(F.col("vec_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(2750.0))
    hi = F.when(F.col("vec_id") % 2 == 0, F.lit(2950.5)).otherwise(F.lit(None).cast("double"))
    return e.select(F.col("vec_id").alias("query_id"), T.price_line(lo, hi).alias("price_line"))


def _c12_oracle() -> str:
    t = O.strip("coalesce(reply, '')")
    unf = O.strip(f"regexp_replace(regexp_replace({t}, '^`+|`+$', '', 'g'), 'json', '')")
    body = f"(CASE WHEN starts_with({t}, '```') THEN {unf} ELSE {t} END)"

    def price(key: str) -> str:
        k = f"json_type(js, '$.{key}')"
        txt = O.strip(f"replace(json_extract_string(js, '$.{key}'), ',', '')")
        return (f"CASE WHEN {k} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN CAST(json_extract(js, '$.{key}') AS DOUBLE) "
                f"WHEN {k} = 'BOOLEAN' THEN CASE WHEN json_extract_string(js, '$.{key}') = 'true' THEN 1.0 ELSE 0.0 END "
                f"WHEN {k} = 'VARCHAR' AND regexp_matches({txt}, '{O.NUMBER_RE}') THEN CAST({txt} AS DOUBLE) END")
    return f"""
WITH {', '.join(f'{n} AS ({b})' for n, b in [])}plan AS ({PLAN_REPLIES_SQL.replace('STRING', 'VARCHAR')}),
b AS (SELECT conv_id, turn, query, {body} AS body FROM plan),
j AS (SELECT *, CASE WHEN coalesce(json_valid(body), false) THEN body ELSE 'null' END AS js FROM b),
k AS (SELECT *, json_type(js) = 'OBJECT' AS is_obj, json_type(js, '$.search_query') AS sqk FROM j),
e AS (SELECT *, CASE WHEN NOT is_obj THEN concat('non-JSON reply: ', body)
                     WHEN sqk IS NOT NULL AND sqk <> 'VARCHAR' THEN 'search_query is not a string' END AS error FROM k)
SELECT conv_id, turn,
  CASE WHEN error IS NULL THEN CASE WHEN coalesce({O.strip("json_extract_string(js, '$.search_query')")}, '') = ''
       THEN {O.strip('query')} ELSE {O.strip("json_extract_string(js, '$.search_query')")} END END AS search_query,
  CASE WHEN error IS NULL THEN CASE WHEN json_type(js, '$.recommended_model') = 'VARCHAR'
       THEN {O.strip("json_extract_string(js, '$.recommended_model')")} ELSE '' END END AS recommended_model,
  CASE WHEN error IS NULL THEN {price('price_min')} END AS price_min,
  CASE WHEN error IS NULL THEN {price('price_max')} END AS price_max,
  error
FROM e"""


def _attach_c12():
    from quaymind.plans.registry import REGISTRY
    from quaymind.sources.fixtures import with_views
    sql = _c12_oracle()
    # the plan replies read the messages view: prepend the shared views it needs
    head = with_views(["messages"], "")
    REGISTRY["c12_parse_query_plan"].oracle = head.rstrip() + ",\n" + sql.strip()[len("WITH "):]


_attach_c12()
