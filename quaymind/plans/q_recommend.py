"""Recommendation jobs: exact vector search -> ranked hits -> records ->
price filter -> model grouping -> model filter -> cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymind.operators import recommend as R
from quaymind.operators.flow import recommend
from quaymind.operators.vectors import vector_topk
from quaymind.plans import oracle_sql as O
from quaymind.plans.registry import query
from quaymind.sources.fixtures import VOCABULARIES, register

CANDIDATE_K = 50
TOP_K = 3
DOMAIN = "shop.example.com"


# per-query search parameters derived from the query id (both engines)
def _price_min(qid):
    return F.when(qid % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(2750.0))


def _price_max(qid):
    return F.when(qid % 2 == 0, F.lit(2950.0)).otherwise(F.lit(None).cast("double"))


PARAMS_SQL = ("CASE WHEN query_id % 3 = 0 THEN NULL ELSE 2750.0 END",
              "CASE WHEN query_id % 2 = 0 THEN 2950.0 ELSE NULL END")


def search_hits(spark: SparkSession, sf: str, k: int = CANDIDATE_K) -> DataFrame:
    """Every embedding searches the whole embedding corpus (self top-k)."""
    register(spark, sf)
    emb = spark.table("embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = emb.select(F.col("vec_id").alias("product_id"),
                        (F.col("vec_id") * 10 + 1).alias("variant_id"), "embedding")
    return vector_topk(queries, corpus, k)


def diverse(spark: SparkSession, sf: str, k: int = TOP_K) -> DataFrame:
    hits = search_hits(spark, sf)
    hits = hits.withColumn("price_min", _price_min(F.col("query_id"))) \
               .withColumn("price_max", _price_max(F.col("query_id")))
    return R.diverse_models(hits, spark.table("catalog"), k, price_min="price_min",
                            price_max="price_max", domain=DOMAIN)


def _flat(df: DataFrame) -> DataFrame:
    return (df.withColumn("storage_options", F.array_join("storage_options", "|"))
              .withColumn("condition_options", F.array_join("condition_options", "|"))
              .withColumn("color_options", F.array_join("color_options", "|")))


DIVERSE_COLS = ["query_id", "position", "rank", "handle", "product_id", "variant_id", "price",
                "from_price", "best_score", "storage_options", "condition_options", "color_options",
                "variant_link", "product_link"]

# ---- oracle CTEs --------------------------------------------------------------

HITS_CTES = [
    ("q", f"SELECT vec_id AS query_id, embedding FROM embeddings"),
    ("scored", """SELECT q.query_id, c.vec_id AS product_id, c.vec_id * 10 + 1 AS variant_id,
        round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
        FROM q CROSS JOIN embeddings c"""),
    ("hits", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, product_id, variant_id) AS rank FROM scored) WHERE rank <= 50"""),
]

DIVERSE_CTES = HITS_CTES + [
    ("hp", f"SELECT *, {PARAMS_SQL[0]} AS price_min, {PARAMS_SQL[1]} AS price_max FROM hits"),
    ("recs", f"""SELECT h.*, {O.blank('k.handle')} AS handle, k.color, k.spec, k.condition, k.tenure,
        k.price, {O.parse_price('k.price')} AS p
        FROM hp h LEFT JOIN catalog k ON h.product_id = k.product_id AND h.variant_id = k.variant_id"""),
    ("f", """SELECT * FROM recs WHERE handle <> '' AND (p IS NULL OR ((price_min IS NULL OR p >= price_min)
        AND (price_max IS NULL OR p < price_max)))"""),
    ("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, handle
        ORDER BY score DESC, coalesce(p, CAST('Infinity' AS DOUBLE)), rank) AS rn FROM f) WHERE rn = 1"""),
    ("agg", "SELECT query_id, handle, min(rank) AS first_rank, min(p) AS from_price FROM f GROUP BY query_id, handle"),
    ("specs", f"""SELECT query_id, handle, string_agg(v, '|' ORDER BY gb, lower(v), o) AS storage_options FROM (
        SELECT query_id, handle, {O.blank('spec')} AS v, min(rank) AS o, {O.storage_gb('spec')} AS gb
        FROM f WHERE {O.blank('spec')} <> '' GROUP BY query_id, handle, {O.blank('spec')}, {O.storage_gb('spec')})
        GROUP BY query_id, handle"""),
    ("conds", f"""SELECT query_id, handle, string_agg(v, '|' ORDER BY o) AS condition_options FROM (
        SELECT query_id, handle, {O.blank('condition')} AS v, min(rank) AS o FROM f
        WHERE {O.blank('condition')} <> '' GROUP BY ALL) GROUP BY query_id, handle"""),
    ("colors", f"""SELECT query_id, handle, string_agg(v, '|' ORDER BY o) AS color_options FROM (
        SELECT query_id, handle, {O.blank('color')} AS v, min(rank) AS o FROM f
        WHERE {O.blank('color')} <> '' GROUP BY ALL) GROUP BY query_id, handle"""),
    ("grouped", f"""SELECT a.query_id, a.handle, a.first_rank AS rank, b.product_id, b.variant_id, b.price,
        a.from_price, b.score AS best_score, coalesce(s.storage_options, '') AS storage_options,
        coalesce(c.condition_options, '') AS condition_options, coalesce(l.color_options, '') AS color_options,
        b.color, b.spec, b.condition, b.tenure,
        concat('https://{DOMAIN}/products/', a.handle, '?variant=', CAST(b.variant_id AS VARCHAR)) AS variant_link,
        concat('https://{DOMAIN}/products/', a.handle) AS product_link
        FROM agg a JOIN best b ON a.query_id = b.query_id AND a.handle = b.handle
        LEFT JOIN specs s ON a.query_id = s.query_id AND a.handle = s.handle
        LEFT JOIN conds c ON a.query_id = c.query_id AND a.handle = c.handle
        LEFT JOIN colors l ON a.query_id = l.query_id AND a.handle = l.handle"""),
    ("diverse", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position
        FROM grouped) WHERE position <= {TOP_K}"""),
]


@query("v3_vector_topk", O.sql([], HITS_CTES, "SELECT query_id, rank, product_id, variant_id, score FROM hits"))
def q_vector_topk(spark, sf):
    """V3 + W1: exact inner-product top-50 of every embedding against all embeddings."""
    return search_hits(spark, sf)


@query("g7_diverse_models", O.sql(["catalog"], DIVERSE_CTES,
                                  "SELECT " + ", ".join(DIVERSE_COLS) + " FROM diverse"))
def q_diverse_models(spark, sf):
    """V3 -> W1 -> J2 -> P1 -> G7 (flagship): top-3 distinct models per query."""
    return _flat(diverse(spark, sf)).select(*DIVERSE_COLS)


# ---- cards, full recommend flow, search helpers -------------------------------

from quaymind.operators.vectors import l2_normalize  # noqa: E402
from quaymind.plans.q_classify import p8_sql  # noqa: E402


def _compact_sql(lst: str) -> str:
    v = O.ordered_unique(f"list_filter(list_transform({lst}, lambda w: {O.blank('w')}), lambda w: w <> '' AND lower(w) <> 'none')")
    return f"(CASE WHEN len({v}) = 0 THEN '-' ELSE array_to_string({v}, ' / ') END)"


def _pretty_sql(h: str) -> str:
    return (f"(CASE WHEN {O.blank(h)} = '' THEN 'Unknown model' ELSE array_to_string(list_transform("
            f"string_split(regexp_replace({O.blank(h)}, '-flash-deal$', ''), '-'), "
            f"lambda p: concat(upper(left(p, 1)), lower(substr(p, 2)))), ' ') END)")


def _price_sql(p: str) -> str:
    return (f"(CASE WHEN {p} IS NULL THEN '-' WHEN {p} = floor({p}) THEN concat('RM', format('{{:,}}', CAST({p} AS BIGINT))) "
            f"ELSE concat('RM', format('{{:,.2f}}', {p})) END)")


def _card_sql(n: str) -> str:
    opts = _compact_sql("string_split(storage_options, '|')")
    conds = _compact_sql("string_split(condition_options, '|')")
    cols = _compact_sql("string_split(color_options, '|')")
    link = f"CASE WHEN {O.blank('product_link')} = '' THEN '-' ELSE {O.blank('product_link')} END"
    return (f"concat(CAST({n} AS VARCHAR), '. ', {_pretty_sql('handle')}, chr(10), 'From ', {_price_sql('from_price')}, chr(10),"
            f" 'Options: ', {opts}, chr(10), 'Condition: ', {conds}, chr(10), 'Color: ', {cols}, chr(10),"
            f" 'View options: ', {link})")


@query("b5_render_cards", O.sql(["catalog"], DIVERSE_CTES, f"""
SELECT query_id, string_agg({_card_sql('position')}, concat(chr(10), chr(10)) ORDER BY position) AS cards
FROM diverse GROUP BY query_id"""))
def b5(spark, sf):
    """B5 numbered result cards of every search (flagship rows)."""
    return R.render_cards(diverse(spark, sf))


MODEL_OF_QUERY = "CASE query_id % 3 WHEN 0 THEN '' WHEN 1 THEN replace(mk.handle, '-', ' ') ELSE 'galaxy 99 ultra' END"
REPLY_OF_QUERY = ("CASE query_id % 2 WHEN 0 THEN concat('Try the ', replace(mk.handle, '-', ' '), ' today!') "
                  "ELSE 'Here are a few options.' END")


_LO = "(CASE WHEN e.vec_id % 3 = 0 THEN NULL ELSE 2750.0::DOUBLE END)"
_HI = "(CASE WHEN e.vec_id % 2 = 0 THEN 2950.0::DOUBLE ELSE NULL END)"
NO_MATCH_SQL = f"""CASE WHEN {_LO} IS NOT NULL AND {_HI} IS NOT NULL
    THEN concat('No matches in range ', CAST({_LO} AS VARCHAR), ' to ', CAST({_HI} AS VARCHAR), '.')
  WHEN {_HI} IS NOT NULL THEN concat('No matches under ', CAST({_HI} AS VARCHAR), '.')
  WHEN {_LO} IS NOT NULL THEN concat('No matches above ', CAST({_LO} AS VARCHAR), '.') ELSE 'No matches after filtering.' END"""


@query("v4_recommend", O.sql(["catalog"], DIVERSE_CTES + [
    ("dm", f"""SELECT d.*, {MODEL_OF_QUERY} AS model,
        trim(regexp_replace(lower({REPLY_OF_QUERY}), '[^a-z0-9]+', ' ', 'g')) AS rep
        FROM diverse d LEFT JOIN catalog mk ON mk.product_id = d.query_id"""),
    ("m5", f"SELECT *, coalesce({p8_sql('model', 'handle')}, false) AS m FROM dm"),
    ("f5", "SELECT query_id, bool_or(m) AS recommended_in_results FROM m5 GROUP BY query_id"),
    ("k5", "SELECT m5.*, f5.recommended_in_results FROM m5 JOIN f5 USING (query_id) WHERE m5.m OR NOT f5.recommended_in_results"),
    ("m6", f"""SELECT *, coalesce(rep <> '' AND trim(regexp_replace(lower({O.blank('handle')}), '[^a-z0-9]+', ' ', 'g')) <> ''
        AND strpos(rep, trim(regexp_replace(lower({O.blank('handle')}), '[^a-z0-9]+', ' ', 'g'))) > 0, false) AS m6 FROM k5"""),
    ("f6", "SELECT query_id, bool_or(m6) AS anym FROM m6 GROUP BY query_id"),
    ("k6", """SELECT m6.*, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n
        FROM m6 JOIN f6 USING (query_id) WHERE m6.m6 OR NOT f6.anym""")], f"""
SELECT e.vec_id AS query_id, coalesce(c.cards, {NO_MATCH_SQL}) AS answer, CAST(coalesce(c.n, 0) AS BIGINT) AS n_models,
  coalesce(c.recommended_in_results, false) AS recommended_in_results, c.cards IS NOT NULL AS found
FROM (SELECT query_id, bool_or(recommended_in_results) AS recommended_in_results, count(*) AS n,
  string_agg({_card_sql('n')}, concat(chr(10), chr(10)) ORDER BY n) AS cards
FROM k6 GROUP BY query_id) c RIGHT JOIN embeddings e ON e.vec_id = c.query_id"""))
def v4(spark, sf):
    """V4 full recommend flow, one answer per query: search -> group models -> model filter -> mention filter ->
    cards, or the no-match message."""
    register(spark, sf)
    emb = spark.table("embeddings")
    mk = spark.table("catalog").select(F.col("product_id").alias("query_id"), F.col("handle").alias("_qh"))
    queries = (emb.select(F.col("vec_id").alias("query_id"), "embedding").join(mk, "query_id", "left")
               .withColumn("price_min", _price_min(F.col("query_id"))).withColumn("price_max", _price_max(F.col("query_id")))
               .withColumn("model", F.expr(MODEL_OF_QUERY.replace("mk.handle", "_qh")))
               .withColumn("reply", F.expr(REPLY_OF_QUERY.replace("mk.handle", "_qh"))))
    corpus = emb.select(F.col("vec_id").alias("product_id"), (F.col("vec_id") * 10 + 1).alias("variant_id"), "embedding")
    return recommend(queries, corpus, spark.table("catalog"), stopwords=VOCABULARIES["stopwords"], models=TOP_K,
                     candidates=CANDIDATE_K, domain=DOMAIN)


@query("s1_available_models", O.sql(["catalog"], [], """
SELECT handle FROM (SELECT DISTINCT handle FROM catalog WHERE handle ILIKE 'b%' ORDER BY handle LIMIT 50) WHERE handle <> ''"""))
def s1(spark, sf):
    """S1 first 50 distinct handles with a case-insensitive prefix (a limit is the feature)."""
    register(spark, sf)
    return R.available_models(spark.table("catalog"), "b", 50)


@query("s2_top_k_after_filter", O.sql(["catalog"], HITS_CTES + [
    ("hp", f"SELECT *, {PARAMS_SQL[0]} AS lo, {PARAMS_SQL[1]} AS hi FROM hits"),
    ("rp", f"""SELECT h.*, CASE WHEN regexp_matches({O.strip('k.price')}, '{O.NUMBER_RE}') THEN TRY_CAST({O.strip('k.price')} AS DOUBLE) END AS p
        FROM hp h LEFT JOIN catalog k ON h.product_id = k.product_id AND h.variant_id = k.variant_id""")], """
SELECT query_id, rank, product_id, shown FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS shown FROM rp
  WHERE p IS NULL OR ((lo IS NULL OR p >= lo) AND (hi IS NULL OR p < hi)))
WHERE shown <= 5"""))
def s2(spark, sf):
    """S2 first 5 hits per search that pass the plain-number price filter."""
    hits = search_hits(spark, sf)
    hits = hits.withColumn("lo", _price_min(F.col("query_id"))).withColumn("hi", _price_max(F.col("query_id")))
    out = R.top_k_after_filter(hits, spark.table("catalog"), 5, price_min="lo", price_max="hi")
    return out.select("query_id", "rank", "product_id", "shown")


@query("s3_no_match_message", """
SELECT vec_id AS query_id, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN concat('No matches in range ', CAST(lo AS VARCHAR), ' to ', CAST(hi AS VARCHAR), '.')
  WHEN hi IS NOT NULL THEN concat('No matches under ', CAST(hi AS VARCHAR), '.')
  WHEN lo IS NOT NULL THEN concat('No matches above ', CAST(lo AS VARCHAR), '.') ELSE 'No matches after filtering.' END AS message
FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 2750.0::DOUBLE END AS lo,
             CASE WHEN vec_id % 2 = 0 THEN 2950.0::DOUBLE ELSE NULL END AS hi FROM embeddings)""")
def s3(spark, sf):
    """S3 empty-result message for every search's bounds."""
    register(spark, sf)
    q = F.col("vec_id")
    return spark.table("embeddings").select(q.alias("query_id"), R.no_match_message(_price_min(q), _price_max(q)).alias("message"))


@query("s4_constrain_model", O.sql(["catalog"], [
    ("allowed", "SELECT DISTINCT handle FROM catalog WHERE handle ILIKE 'b%' AND handle <> ''"),
    ("rm", "SELECT product_id, CASE product_id % 3 WHEN 0 THEN handle WHEN 1 THEN concat(handle, '-x') ELSE '' END AS model FROM catalog")], """
SELECT product_id, CASE WHEN coalesce(model, '') = '' OR model IN (SELECT handle FROM allowed) THEN model ELSE '' END AS model FROM rm"""))
def s4(spark, sf):
    """S4 recommended models outside the allowed handle list blanked."""
    register(spark, sf)
    allowed = R.available_models(spark.table("catalog"), "b", None)
    rm = spark.table("catalog").select("product_id", F.expr(
        "CASE product_id % 3 WHEN 0 THEN handle WHEN 1 THEN concat(handle, '-x') ELSE '' END").alias("model"))
    return R.constrain_model(rm, "model", allowed)


@query("g8_ordered_distinct", O.sql(["messages"], [], f"""
SELECT conv_id, string_agg(v, '|' ORDER BY o) AS roles FROM (
  SELECT conv_id, {O.blank('role')} AS v, min(turn) AS o FROM messages WHERE {O.blank('role')} <> '' GROUP BY ALL)
GROUP BY conv_id"""))
def g8(spark, sf):
    """G8 distinct roles per conversation in first-seen order."""
    register(spark, sf)
    out = R.ordered_distinct_df(spark.table("messages"), "conv_id", "role", "turn")
    return out.select("conv_id", F.array_join("values", "|").alias("roles"))


@query("w1_rank_hits", """
SELECT query_id, rank, product_id, variant_id, score FROM (
  SELECT l_orderkey AS query_id, l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS variant_id, l_extendedprice AS score,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank
  FROM lineitem) WHERE rank <= 2""")
def w1(spark, sf):
    """W1 top-2 line items per order by price (ties by key)."""
    register(spark, sf)
    s = spark.table("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("product_id"),
                                       F.col("l_linenumber").cast("bigint").alias("variant_id"),
                                       F.col("l_extendedprice").alias("score"))
    return R.rank_hits(s, 2).select("query_id", "rank", "product_id", "variant_id", "score")


@query("w2_first_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def w2(spark, sf):
    """W2 first order of every customer (by date, then key)."""
    register(spark, sf)
    o = spark.table("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.first_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("v2_l2_normalize", """
SELECT vec_id, round(sqrt(list_sum(list_transform(n, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
  round(CAST(n[1] AS DOUBLE), 6) + 0.0 AS first_component FROM (
  SELECT vec_id, CASE WHEN s > 0 THEN list_transform(v, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(s) AS FLOAT)) ELSE v END AS n FROM (
    SELECT vec_id, v, list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS s FROM (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x * (vec_id % 4) AS FLOAT)) AS v FROM embeddings)))""")
def v2(spark, sf):
    """V2 unit-length vectors of scaled embeddings (zero vectors unchanged)."""
    register(spark, sf)
    e = spark.table("embeddings").select("vec_id", F.transform("embedding", lambda x: (x * (F.col("vec_id") % 4)).cast("float")).alias("v"))
    n = e.select("vec_id", l2_normalize("v").alias("n"))
    sq = F.aggregate("n", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return n.select("vec_id", F.round(F.sqrt(sq), 6).alias("norm"), (F.round(F.col("n")[0].cast("double"), 6) + F.lit(0.0)).alias("first_component"))
