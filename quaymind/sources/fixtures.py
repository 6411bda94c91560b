"""Derived fixture views over the driver tables (FIXTURES.md section 3).

The row-level views are plain SQL that both Spark SQL and DuckDB run
unchanged, so the Spark operators and the SQL oracle start from identical
inputs.  Vocabularies are our own short word lists, handed to operators as
DataFrame parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

# --- shared SQL (runs in Spark SQL and DuckDB) -----------------------------

CATALOG_SQL = """
SELECT p_partkey AS product_id,
       p_partkey * 10 + 1 AS variant_id,
       split_part(p_name, ' ', 1) AS color,
       CASE WHEN p_size % 7 = 0 THEN ''
            WHEN p_size % 5 = 0 THEN concat(cast(cast(floor(p_size / 5) AS BIGINT) AS STRING), 'TB')
            ELSE concat(cast(64 * (1 + p_size % 4) AS STRING), 'GB') END AS spec,
       CASE WHEN p_type = 'PROMO' THEN 'Excellent' WHEN p_type = 'LARGE' THEN 'Good'
            WHEN p_type = 'SMALL' THEN 'Fair' ELSE CAST(NULL AS STRING) END AS condition,
       CASE WHEN p_partkey % 11 = 0 THEN CAST(NULL AS STRING)
            WHEN p_partkey % 3 = 0 THEN concat('RM', cast(cast(floor(cents / 100000) AS BIGINT) AS STRING), ',',
                 lpad(cast(cast(floor((cents % 100000) / 100) AS BIGINT) AS STRING), 3, '0'), '.',
                 lpad(cast(cents % 100 AS STRING), 2, '0'))
            ELSE concat(cast(cast(floor(cents / 100) AS BIGINT) AS STRING), '.', lpad(cast(cents % 100 AS STRING), 2, '0'))
       END AS price,
       CASE WHEN p_partkey % 13 = 0 THEN '' ELSE replace(p_name, ' ', '-') END AS handle,
       p_brand AS vendor,
       p_type AS product_type,
       CAST(NULL AS STRING) AS tenure
FROM (SELECT p_partkey, p_name, p_brand, p_type, p_size,
             cast(round(p_retailprice * 300) AS BIGINT) AS cents FROM part) p
"""

from quaymind.fixed import CLOSED_MARKER  # noqa: E402,F401  (the fixture store names carry it)

STORES_SQL = """
SELECT s.s_suppkey AS id,
       concat(s.s_name, ' Kiosk',
              CASE WHEN s.s_suppkey % 14 = 0 THEN ' (Temporarily Closed)'
                   WHEN s.s_suppkey % 7 = 0 THEN ' - TEMPORARILY CLOSED' ELSE '' END) AS name,
       concat('https://wa.me/60', cast(100000 + s.s_suppkey AS STRING)) AS whatsappLink,
       concat('Unit ', cast(s.s_suppkey % 40 + 1 AS STRING), ', ', n.n_name, ', ', r.r_name) AS location,
       '10:00-22:00' AS operatingHours
FROM supplier s
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

LOCATIONS_SQL = """
SELECT term, CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS ordinal, needle
FROM (SELECT lower(n_name) AS term, n_name AS needle FROM nation
      UNION ALL
      SELECT lower(r_name) AS term, r_name AS needle FROM region
      UNION ALL
      SELECT 'atlantis' AS term, 'Atlantis' AS needle) t
"""

# bucket = (conv_id + turn div 2) % 10 picks the injected user text
MESSAGES_SQL = """
SELECT conv_id, turn, role,
  CASE WHEN role <> 'user' THEN text
       WHEN bucket = 0 THEN concat('Which kiosk is the closest to nation_', cast((conv_id + turn) % 25 AS STRING), '?')
       WHEN bucket = 1 THEN CASE (conv_id + turn) % 5 WHEN 0 THEN 'Africa' WHEN 1 THEN 'america'
                                 WHEN 2 THEN 'ASIA' WHEN 3 THEN 'Europe' ELSE 'middle east' END
       WHEN bucket = 2 THEN 'How do I use the guarantee for my order?'
       WHEN bucket = 3 THEN CASE conv_id % 4 WHEN 0 THEN 'howdy' WHEN 1 THEN 'howdy folks, anyone around'
                                 WHEN 2 THEN 'howdy!' ELSE ' Fine morning team' END
       WHEN bucket = 4 THEN 'Please connect me to a live person'
       WHEN bucket = 5 THEN 'show me something lighter for 2000 ringgit'
       WHEN bucket = 6 THEN 'how many weeks does the courier need'
       WHEN bucket = 7 THEN concat('tolong, jalan ke nation_', cast((conv_id + turn) % 25 AS STRING))
       WHEN bucket = 8 THEN 'I already filed a complaint last week'
       WHEN conv_id % 3 = 0 THEN 'Which showroom has parking?'
       WHEN conv_id % 3 = 1 THEN 'is there a kiosk in Atlantis'
       ELSE text END AS text
FROM (SELECT conv_id, turn, role, text,
             CAST((conv_id + CAST(floor(turn / 2) AS BIGINT)) % 10 AS BIGINT) AS bucket
      FROM conversations) c
"""

KB_SQL = """
SELECT item_id AS ordinal,
       concat(' ', CASE WHEN item_id % 2 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END) AS keyword,
       text AS answer
FROM benchmark
UNION ALL
SELECT item_id + 1000000 AS ordinal, concat(text, '  ') AS keyword,
       concat('second answer: ', text) AS answer
FROM benchmark WHERE item_id % 5 = 0
"""

# last user turn of each conversation is the question; history = turns up to it
QUESTIONS_SQL = """
SELECT conv_id, turn AS q_turn, text AS question FROM (
  SELECT conv_id, turn, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM messages WHERE role = 'user') u
WHERE rn = 1
"""

HISTORY_SQL = """
SELECT m.conv_id, m.turn, m.text
FROM messages m JOIN questions q ON m.conv_id = q.conv_id AND m.turn <= q.q_turn
"""

# model labels for the knowledge-base join J3 (what a routing model answers)
LABELS_SQL = """
SELECT conv_id, turn,
  CASE CAST((conv_id + turn) % 6 AS BIGINT)
       WHEN 0 THEN translate(k.keyword, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
       WHEN 1 THEN trim(k.keyword)
       WHEN 2 THEN 'PRODUCT_ENQUIRE'
       WHEN 3 THEN 'no_match'
       WHEN 4 THEN translate(trim(k.keyword), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
       ELSE concat(trim(k.keyword), '?') END AS label
FROM messages m
JOIN kb k ON k.ordinal = (m.conv_id + m.turn) % (SELECT max(item_id) + 1 FROM benchmark)
WHERE m.role = 'user'
"""
KB_ROWS = "(SELECT max(item_id) + 1 FROM benchmark)"

# next version of the catalog: some prices and handles changed, some rows
# gone, some new (input for the changed-rows job G6)
CATALOG_NEXT_SQL = """
SELECT product_id, variant_id, color, spec, condition,
       CASE WHEN product_id % 17 = 0 THEN concat(coalesce(price, ''), '9') ELSE price END AS price,
       CASE WHEN product_id % 23 = 0 THEN concat(handle, '-v2') ELSE handle END AS handle,
       vendor, product_type, tenure
FROM catalog WHERE product_id % 29 <> 0
UNION ALL
SELECT product_id + 1000000 AS product_id, variant_id + 10000000 AS variant_id, color, spec, condition, price,
       handle, vendor, product_type, tenure
FROM catalog WHERE product_id % 31 = 0
"""

SHARED_VIEWS = [
    ("catalog", CATALOG_SQL),
    ("catalog_next", CATALOG_NEXT_SQL),
    ("stores", STORES_SQL),
    ("locations", LOCATIONS_SQL),
    ("messages", MESSAGES_SQL),
    ("kb", KB_SQL),
    ("questions", QUESTIONS_SQL),
    ("history", HISTORY_SQL),
    ("route_labels", LABELS_SQL),
]

# --- vocabularies (our own short word lists; parameters, not constants) ------

VOCABULARIES: dict[str, list[str]] = {
    "strong_location": ["kiosk", "showroom", "landmark", "postcode", "parking"],
    "weak_location": ["closest", "reach", "drive", "situated", "corner"],
    "strong_faq": ["guarantee", "reimbursement", "unlocking", "insurance"],
    "weak_faq": ["courier", "parcel", "invoice", "weeks", "receipt"],
    "malay": ["tolong", "berapa", "harga", "terima", "kasih", "pagi", "jalan"],
    "greeting": ["howdy", "greetings", "salutations", "fine morning"],
    "human": ["supervisor", "live person", "staff member"],
    "ticket": ["complaint", "raise a case"],
    "ticket_logged": ["complaint filed", "already filed a complaint"],
    "stopwords": ["the", "an", "of", "to", "my", "that", "on"],
    "refinement": ["lighter", "smaller", "larger", "newer", "ringgit", "discount"],
}

# FAQ section keyword map: section -> phrases (ordered)
FAQ_KEYWORDS: list[tuple[str, list[str]]] = [
    ("user", ["guarantee", "repair", "order"]),
    ("assistant", ["courier", "how many weeks", "parcel"]),
    ("system", ["complaint", "supervisor"]),
]


def vocab_df(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = [(v, t, i + 1) for v, terms in VOCABULARIES.items() if names is None or v in names
            for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "vocab string, term string, ordinal bigint")


def faq_keywords_df(spark: SparkSession) -> DataFrame:
    rows = [(sec, si + 1, kw) for si, (sec, kws) in enumerate(FAQ_KEYWORDS) for kw in kws]
    return spark.createDataFrame(rows, "section string, ordinal bigint, keyword string")


def vocab_values_sql(names: list[str] | None = None) -> str:
    """The vocabularies as a SQL VALUES body (for the DuckDB oracle)."""
    rows = [(v, t, i + 1) for v, terms in VOCABULARIES.items() if names is None or v in names
            for i, t in enumerate(terms)]
    vals = ", ".join("('%s', '%s', %d)" % (v, t.replace("'", "''"), o) for v, t, o in rows)
    return f"SELECT * FROM (VALUES {vals}) AS t(vocab, term, ordinal)"


def faq_keywords_sql() -> str:
    rows = [(sec, si + 1, kw) for si, (sec, kws) in enumerate(FAQ_KEYWORDS) for kw in kws]
    vals = ", ".join("('%s', %d, '%s')" % (s, o, k) for s, o, k in rows)
    return f"SELECT * FROM (VALUES {vals}) AS t(section, ordinal, keyword)"


_REGISTERED: dict[tuple[str, int], str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register base tables and shared derived views as temp views
    (once per session and scale directory)."""
    from quaymind.session import ship_package
    ship_package(spark)
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists("route_labels"):
        return
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    # streams can't hold the oracle's scalar subquery: its value goes into the text
    last = spark.table("benchmark").selectExpr("max(item_id) + 1").head()[0]
    for name, sql in SHARED_VIEWS:
        spark.sql(sql.replace(KB_ROWS, str(last))).createOrReplaceTempView(name)
    spark.sql(FAQ_DOCS_SPARK).createOrReplaceTempView("faq_docs")
    _REGISTERED[key] = sf_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)


def with_views(names: list[str], body: str) -> str:
    """Prefix an oracle query with the shared views it needs as CTEs."""
    order = [n for n, _ in SHARED_VIEWS] + ["faq_docs", "vocab", "faq_keywords"]
    needed = set(names)
    deps = {"questions": ["messages"], "catalog_next": ["catalog"], "history": ["messages", "questions"],
            "route_labels": ["messages", "kb"]}
    changed = True
    while changed:
        changed = False
        for n in list(needed):
            for d in deps.get(n, []):
                if d not in needed:
                    needed.add(d)
                    changed = True
    sql_of = dict(SHARED_VIEWS)
    sql_of["faq_docs"] = FAQ_DOCS_DUCK
    sql_of["vocab"] = vocab_values_sql()
    sql_of["faq_keywords"] = faq_keywords_sql()
    ctes = [f"{n} AS ({sql_of[n]})" for n in order if n in needed]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


# one markdown document per conversation: '## role' heading + text per turn
FAQ_DOCS_SPARK = """
SELECT conv_id AS doc_id,
       array_join(transform(array_sort(collect_list(named_struct('t', turn, 's', concat('## ', role, '\\n', text)))),
                            x -> x.s), '\\n') AS text
FROM conversations GROUP BY conv_id
"""

FAQ_DOCS_DUCK = """
SELECT conv_id AS doc_id,
       string_agg(concat('## ', role, chr(10), text), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
"""
