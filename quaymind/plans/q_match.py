"""Join jobs: J1-J8 and the routing / store compositions P11, P12, B6, B7."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymind.functions import text as T
from quaymind.operators import classify as C
from quaymind.operators import match as M
from quaymind.operators import project as P
from quaymind.operators import recommend as R
from quaymind.operators.documents import split_sections
from quaymind.plans import oracle_sql as O
from quaymind.plans.q_classify import ALNUM, LOCATION_SUBQ, WORDS, _lst, _ranked
from quaymind.plans.q_recommend import DIVERSE_CTES, HITS_CTES, diverse, search_hits
from quaymind.plans.q_text import LABEL_REPLIES_DUCK, _label_replies_spark, label_sql
from quaymind.plans.registry import query
from quaymind.sources.fixtures import FAQ_KEYWORDS, VOCABULARIES, faq_keywords_df, register

V = VOCABULARIES


@query("j1_lookup_records", O.sql(["catalog"], [], """
SELECT * FROM catalog WHERE (product_id, variant_id) IN (SELECT l_partkey, l_partkey * 10 + 1 FROM lineitem)"""))
def j1(spark, sf):
    """J1 catalog records for every (part, variant) key ordered in lineitem."""
    register(spark, sf)
    keys = spark.table("lineitem").select(F.col("l_partkey").alias("product_id"),
                                          (F.col("l_partkey") * 10 + 1).alias("variant_id"))
    return R.lookup_records(keys, spark.table("catalog"))


@query("j2_attach_records", O.sql(["catalog"], HITS_CTES, f"""
SELECT h.query_id, h.rank, h.product_id, h.variant_id, {O.blank('k.handle')} AS handle, k.price
FROM hits h LEFT JOIN catalog k ON h.product_id = k.product_id AND h.variant_id = k.variant_id
WHERE {O.blank('k.handle')} <> ''"""))
def j2(spark, sf):
    """J2 record fields for every ranked hit; missing / blank-handle records dropped."""
    hits = search_hits(spark, sf)
    return R.attach_records(hits, spark.table("catalog")).select(
        "query_id", "rank", "product_id", "variant_id", "handle", "price")


_lab, _score = label_sql("reply")
KB_FIRST = f"""SELECT * FROM (SELECT *, lower({O.strip('keyword')}) AS k,
  row_number() OVER (PARTITION BY lower({O.strip('keyword')}) ORDER BY ordinal) AS rn FROM kb) WHERE rn = 1"""


@query("j3_kb_match", O.sql(["route_labels", "kb"], [
    ("replies", LABEL_REPLIES_DUCK),
    ("labels", f"SELECT conv_id, turn, {_lab} AS match FROM replies"),
    ("kbf", KB_FIRST)], """
SELECT l.conv_id, l.turn, l.match, f.ordinal AS kb_ordinal, f.keyword, f.answer
FROM labels l LEFT JOIN kbf f ON l.match <> 'PRODUCT_ENQUIRE' AND lower(l.match) = f.k"""))
def j3(spark, sf):
    """J3 knowledge-base row for every routing label (first row wins)."""
    register(spark, sf)
    labels = _label_replies_spark(spark).select("conv_id", "turn",
                                                T.normalize_label(F.col("reply"))["match"].alias("match"))
    return M.kb_match(labels, spark.table("kb"))


STORE_MATCH_CTES = [
    ("mt", f"SELECT m.conv_id, m.turn, m.text, {LOCATION_SUBQ} AS location_term FROM messages m"),
    ("sm", """SELECT DISTINCT mt.conv_id, mt.turn, mt.location_term, s.id AS store_id, s.name, s.location,
        s.operatingHours, s.whatsappLink, strpos(lower(s.name), 'temporarily closed') > 0 AS closed
        FROM mt JOIN locations l ON l.term = mt.location_term
        JOIN stores s ON strpos(lower(s.location), lower(l.needle)) > 0 OR strpos(lower(s.name), lower(l.needle)) > 0"""),
]


def _store_matches(spark, sf):
    register(spark, sf)
    m = C.detect_location(spark.table("messages"), "text", spark.table("locations"))
    return M.match_stores(m, spark.table("locations"), spark.table("stores"), known_terms=True)


@query("j4_match_stores", O.sql(["messages", "locations", "stores"], STORE_MATCH_CTES, """
SELECT conv_id, turn, location_term, store_id, closed FROM sm"""))
def j4(spark, sf):
    """J4 stores matching the location detected in every message."""
    return _store_matches(spark, sf).select("conv_id", "turn", "location_term", "store_id", "closed")


MODEL_OF_QUERY = "CASE query_id % 3 WHEN 0 THEN '' WHEN 1 THEN replace(mk.handle, '-', ' ') ELSE 'galaxy 99 ultra' END"


def _diverse_with_model(spark, sf):
    d = diverse(spark, sf)
    cat = spark.table("catalog").select(F.col("product_id").alias("query_id"), F.col("handle").alias("_qh"))
    model = F.expr(MODEL_OF_QUERY.replace("mk.handle", "_qh"))
    return d.join(cat, "query_id", "left").withColumn("model", model).drop("_qh")


@query("j5_semi_or_all_by_model", O.sql(["catalog"], DIVERSE_CTES + [
    ("dm", f"""SELECT d.*, {MODEL_OF_QUERY} AS model FROM diverse d LEFT JOIN catalog mk ON mk.product_id = d.query_id"""),
    ("mm", f"SELECT *, coalesce({__import__('quaymind.plans.q_classify', fromlist=['p8_sql']).p8_sql('model', 'handle')}, false) AS m FROM dm"),
    ("flag", "SELECT query_id, bool_or(m) AS recommended_in_results FROM mm GROUP BY query_id")], """
SELECT mm.query_id, mm.position, mm.handle, f.recommended_in_results FROM mm JOIN flag f USING (query_id)
WHERE mm.m OR NOT f.recommended_in_results"""))
def j5(spark, sf):
    """J5 keep-matching-or-all by recommended model over the flagship results."""
    d = _diverse_with_model(spark, sf)
    return R.semi_or_all_by_model(d, "model", V["stopwords"]).select(
        "query_id", "position", "handle", "recommended_in_results")


REPLY_OF_QUERY = ("CASE query_id % 2 WHEN 0 THEN concat('Try the ', replace(mk.handle, '-', ' '), ' today!') "
                  "ELSE 'Here are a few options.' END")


@query("j6_semi_or_all_by_mention", O.sql(["catalog"], DIVERSE_CTES + [
    ("dr", f"""SELECT d.*, trim(regexp_replace(lower({REPLY_OF_QUERY}), '[^a-z0-9]+', ' ', 'g')) AS rep,
        trim(regexp_replace(lower({O.blank('d.handle')}), '[^a-z0-9]+', ' ', 'g')) AS hp
        FROM diverse d LEFT JOIN catalog mk ON mk.product_id = d.query_id"""),
    ("mm", "SELECT *, coalesce(rep <> '' AND hp <> '' AND strpos(rep, hp) > 0, false) AS m FROM dr"),
    ("flag", "SELECT query_id, bool_or(m) AS anym FROM mm GROUP BY query_id")], """
SELECT mm.query_id, mm.position, mm.handle FROM mm JOIN flag f USING (query_id) WHERE mm.m OR NOT f.anym"""))
def j6(spark, sf):
    """J6 keep-mentioned-or-all by reply text over the flagship results."""
    d = diverse(spark, sf)
    cat = spark.table("catalog").select(F.col("product_id").alias("query_id"), F.col("handle").alias("_qh"))
    d = d.join(cat, "query_id", "left").withColumn("reply", F.expr(REPLY_OF_QUERY.replace("mk.handle", "_qh")))
    return R.semi_or_all_by_mention(d, "reply").select("query_id", "position", "handle")


KW = lambda x: O.ordered_unique(f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda t: length(t) > 2)")


@query("j7_history_reply", O.sql(["history", "questions"], [
    ("h", f"SELECT conv_id, turn, text FROM history WHERE {O.strip('text')} <> ''"),
    ("lastt", "SELECT conv_id, max(turn) AS last_turn FROM h GROUP BY conv_id"),
    ("kq", f"SELECT conv_id, question, {KW('question')} AS kq FROM questions"),
    ("sc", f"""SELECT h.conv_id, h.turn, {O.strip('h.text')} AS t, len(list_intersect(kq.kq, {KW('h.text')})) AS score
        FROM h JOIN lastt USING (conv_id) JOIN kq USING (conv_id)
        WHERE NOT (h.turn = lastt.last_turn AND lower({O.strip('h.text')}) = lower({O.strip('kq.question')}))"""),
    ("best", """SELECT conv_id, t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS rn
        FROM sc WHERE score > 0) WHERE rn = 1""")], """
SELECT q.conv_id, q.q_turn, q.question, b.t AS reply FROM questions q LEFT JOIN best b USING (conv_id)"""))
def j7(spark, sf):
    """J7 best earlier turn (keyword overlap, most recent on ties) for every conversation's question."""
    register(spark, sf)
    return M.history_reply(spark.table("questions"), spark.table("history"))


LB = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def sections_sql(docs: str) -> list[tuple[str, str]]:
    parts = f"string_split_regex(text, '{LB}')"
    arr = (f"CASE WHEN text = '' THEN []::VARCHAR[] WHEN regexp_matches(text, '({LB})$') "
           f"THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END")
    return [
        ("d1_arr", f"SELECT doc_id, {arr} AS arr FROM {docs}"),
        ("d1_lines", "SELECT doc_id, unnest(arr) AS line, unnest(range(1, len(arr) + 1)) AS pos FROM d1_arr"),
        ("d1_tag", """SELECT *, starts_with(line, '## ') AS is_heading,
            sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM d1_lines"""),
        ("d1_heads", f"SELECT doc_id, sec, {O.strip('substr(line, 4)')} AS name FROM d1_tag WHERE is_heading"),
        ("d1_body", """SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY pos) AS text FROM d1_tag
            WHERE NOT is_heading GROUP BY doc_id, sec"""),
        ("d1_occ", """SELECT b.doc_id, b.sec, coalesce(h.name, 'General') AS section, b.text
            FROM d1_body b LEFT JOIN d1_heads h ON b.doc_id = h.doc_id AND b.sec = h.sec"""),
        ("sections", """SELECT doc_id, section, CAST(min(sec) AS BIGINT) AS position, arg_max(text, sec) AS text
            FROM d1_occ GROUP BY doc_id, section"""),
    ]


def _fk_sql():
    rows = [(s, i + 1, k) for i, (s, ks) in enumerate(FAQ_KEYWORDS) for k in ks]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {o}, '{k}')" for s, o, k in rows) + ") AS t(section, ordinal, keyword)"


J8_CTES = sections_sql("faq_docs") + [
    ("fk", _fk_sql()),
    ("um", "SELECT conv_id, turn, text, conv_id AS doc_id FROM messages WHERE role = 'user'"),
    ("cnt", """SELECT um.conv_id, um.turn, fk.section, min(fk.ordinal) AS o,
        count(*) FILTER (WHERE strpos(lower(um.text), fk.keyword) > 0) AS n FROM um CROSS JOIN fk
        GROUP BY um.conv_id, um.turn, fk.section"""),
    ("best", """SELECT conv_id, turn, section FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn
        ORDER BY n DESC, o) AS rn FROM cnt) WHERE rn = 1 AND n > 0"""),
    ("alltext", "SELECT doc_id, string_agg(text, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY position) AS t FROM sections GROUP BY doc_id")]
J8_SELECT = """
SELECT um.conv_id, um.turn, b.section AS best_section, coalesce(s.text, a.t) AS faq_text
FROM um LEFT JOIN best b ON um.conv_id = b.conv_id AND um.turn = b.turn
LEFT JOIN sections s ON s.doc_id = um.doc_id AND s.section = b.section
LEFT JOIN alltext a ON a.doc_id = um.doc_id"""


@query("j8_faq_section", O.sql(["faq_docs", "messages"], J8_CTES, J8_SELECT))
def j8(spark, sf):
    """J8 best FAQ section (keyword phrase count) for every user message."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select(
        "conv_id", "turn", "text", F.col("conv_id").alias("doc_id"))
    sections = split_sections(spark.table("faq_docs"))
    out = M.faq_section(um, faq_keywords_df(spark), sections)
    return out.select("conv_id", "turn", "best_section", "faq_text")


ROUTE_CTES = [
    ("replies", LABEL_REPLIES_DUCK),
    ("labels", f"SELECT conv_id, turn, {_lab} AS lmatch, {_score} AS lscore FROM replies"),
    ("kbf", KB_FIRST),
    ("um", f"""SELECT m.conv_id, m.turn, m.text, {WORDS.replace('text', 'm.text')} AS w, {ALNUM.replace('text', 'm.text')} AS aw,
        {LOCATION_SUBQ} AS loc FROM messages m WHERE m.role = 'user'"""),
    ("flags", f"""SELECT conv_id, turn, loc,
        (list_has_any(w, {_lst(V['strong_location'])}) OR len(list_intersect(w, {_lst(V['weak_location'])})) >= 2
         OR (len(w) <= 6 AND loc IS NOT NULL)) AS is_loc,
        (list_bool_or(list_transform({_lst(V['strong_faq'])}, lambda s: strpos(replace(replace(lower(text), '-', ''), ' ', ''), s) > 0))
         OR len(list_intersect(aw, {_lst(V['weak_faq'])})) >= 2) AS is_faq FROM um"""),
    ("routed", """SELECT f.conv_id, f.turn,
        CASE WHEN f.is_loc AND f.loc IS NULL THEN 'STORE_LOCATOR_NEEDS_LOCATION' WHEN f.is_loc THEN 'STORE_LOCATOR'
             WHEN f.is_faq THEN 'FAQ' END AS intercept, l.lmatch, l.lscore
        FROM flags f LEFT JOIN labels l ON f.conv_id = l.conv_id AND f.turn = l.turn"""),
]


@query("p11_route_messages", O.sql(["messages", "locations", "route_labels", "kb"], ROUTE_CTES, """
SELECT r.conv_id, r.turn, coalesce(r.intercept, r.lmatch) AS match,
  CASE WHEN r.intercept IS NOT NULL THEN 1.0 ELSE r.lscore END AS score,
  CASE WHEN r.intercept IS NOT NULL THEN NULL ELSE k.ordinal END AS kb_ordinal,
  CASE WHEN r.intercept IS NOT NULL THEN r.intercept ELSE k.keyword END AS keyword,
  CASE WHEN r.intercept IS NOT NULL THEN NULL ELSE k.answer END AS answer
FROM routed r LEFT JOIN kbf k ON r.intercept IS NULL AND r.lmatch <> 'PRODUCT_ENQUIRE' AND lower(r.lmatch) = k.k"""))
def p11(spark, sf):
    """P11 route every user message: store locator, FAQ, else knowledge-base label."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    out = M.route_messages(um, _label_replies_spark(spark), spark.table("kb"), V, _ranked(spark))
    return out.select("conv_id", "turn", "match", "score", "kb_ordinal", "keyword", "answer")


LOC_MSG_CTES = STORE_MATCH_CTES + [
    ("um", f"""SELECT m.conv_id, m.turn, m.text, {WORDS.replace('text', 'm.text')} AS w, {LOCATION_SUBQ} AS loc
        FROM messages m WHERE m.role = 'user'"""),
    ("lm", f"""SELECT conv_id, turn, text, loc AS location_term,
        CASE WHEN len(list_intersect(w, {_lst(V['malay'])})) >= 2 THEN 'ms' ELSE 'en' END AS language FROM um
        WHERE list_has_any(w, {_lst(V['strong_location'])}) OR len(list_intersect(w, {_lst(V['weak_location'])})) >= 2
         OR (len(w) <= 6 AND loc IS NOT NULL)"""),
    ("act", """SELECT conv_id, turn, count(*) FILTER (WHERE NOT closed) AS n_active, count(*) FILTER (WHERE closed) AS n_closed,
        string_agg(name, '|' ORDER BY store_id) FILTER (WHERE NOT closed) AS names_all,
        list(struct_pack(i := store_id, n := name, l := location, h := operatingHours, w := whatsappLink)
             ORDER BY store_id) FILTER (WHERE NOT closed) AS act,
        list(name ORDER BY store_id) FILTER (WHERE closed) AS clo FROM sm GROUP BY conv_id, turn"""),
]


# our own fixed replies (P12 parameters)
FIXED_REPLIES = {
    ("needs_location", "en"): "Which town or mall are you near?",
    ("needs_location", "ms"): "Boleh beritahu nama bandar terdekat?",
    ("not_found", "en"): "There is no kiosk at {term} yet.",
    ("not_found", "ms"): "Belum ada kiosk di {term}.",
}
OUTCOME_SQL = """CASE WHEN lm.location_term IS NULL THEN 'needs_location'
       WHEN coalesce(a.n_active, 0) + coalesce(a.n_closed, 0) = 0 THEN 'not_found' ELSE 'stores' END"""
FIXED_REPLY_SQL = "CASE " + " ".join(
    f"WHEN lm.language = '{lang}' AND ({OUTCOME_SQL}) = '{kind}' THEN replace('{said}', '{{term}}', coalesce(lm.location_term, ''))"
    for (kind, lang), said in FIXED_REPLIES.items()) + " END"


@query("p12_store_outcome", O.sql(["messages", "locations", "stores"], LOC_MSG_CTES, f"""
SELECT lm.conv_id, lm.turn, lm.language, lm.location_term, lm.location_term IS NULL AS needs_location,
  coalesce(a.n_active, 0) AS n_active, coalesce(a.n_closed, 0) AS n_closed,
  coalesce(array_to_string(list_transform(list_slice(a.act, 1, 5), lambda x: x.n), '|'), '') AS active_names,
  coalesce(array_to_string(list_slice(a.clo, 1, 5), '|'), '') AS closed_names, {OUTCOME_SQL} AS outcome, {FIXED_REPLY_SQL} AS reply
FROM lm LEFT JOIN act a ON lm.conv_id = a.conv_id AND lm.turn = a.turn"""))
def p12(spark, sf):
    """P12 store-locator outcome of every location question."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    ranked = _ranked(spark)
    loc = um.filter(C.is_location_query("text", V["strong_location"], V["weak_location"], ranked))
    out = M.store_outcome(loc, spark.table("locations"), spark.table("stores"), V["malay"], ranked, replies=FIXED_REPLIES)
    return out.select("conv_id", "turn", "language", "location_term", "needs_location", "n_active", "n_closed",
                      F.array_join("active_names", "|").alias("active_names"),
                      F.array_join("closed_names", "|").alias("closed_names"), "outcome", "reply")


# our own store-reply prompt template (B6 parameters)
PROMPT_HEAD = {"en": "Write a short, friendly reply in English that lists the stores below.",
               "ms": "Tulis balasan ringkas dan mesra dalam Bahasa Melayu yang menyenaraikan kedai di bawah."}


@query("b6_assemble_prompts", O.sql(["messages", "locations", "stores"], LOC_MSG_CTES, f"""
SELECT lm.conv_id, lm.turn, concat(
  CASE WHEN lm.language = 'ms' THEN '{PROMPT_HEAD['ms']}' ELSE '{PROMPT_HEAD['en']}' END,
  chr(10), chr(10), 'Customer message: "', lm.text, '"', chr(10), chr(10),
  CASE WHEN coalesce(len(a.act), 0) = 0 THEN '' ELSE concat('Stores:', chr(10),
    array_to_string(list_transform(list_slice(a.act, 1, 5),
      lambda x: concat('- ', x.n, ': ', x.l, ' | Hours: ', x.h, ' | WhatsApp: ', x.w)), chr(10))) END) AS prompt
FROM lm LEFT JOIN act a ON lm.conv_id = a.conv_id AND lm.turn = a.turn"""))
def b6(spark, sf):
    """B6 store-reply prompt for every location question (first 5 active stores, optional store section)."""
    register(spark, sf)
    um = spark.table("messages").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    ranked = _ranked(spark)
    loc = um.filter(C.is_location_query("text", V["strong_location"], V["weak_location"], ranked))
    df = M.store_outcome(loc, spark.table("locations"), spark.table("stores"), V["malay"], ranked) \
        .withColumn("store_lines", P.store_lines())
    head = F.when(F.col("language") == "ms", F.lit(PROMPT_HEAD["ms"])).otherwise(F.lit(PROMPT_HEAD["en"]))
    parts = [head, "\n\nCustomer message: \"", F.col("text"), "\"\n\n",
             ("optional", "Stores:\n", F.col("store_lines"), "")]
    return P.assemble_prompts(df, parts).select("conv_id", "turn", "prompt")


@query("b7_render_store_list", O.sql(["messages", "locations", "stores"], STORE_MATCH_CTES, """
SELECT conv_id, turn, array_to_string(list_slice(list(concat('📍 ', name, chr(10), '🏢 ', location, chr(10), '🕐 ',
  operatingHours, chr(10), '💬 ', whatsappLink) ORDER BY store_id), 1, 5), concat(chr(10), chr(10))) AS store_list
FROM sm WHERE NOT closed GROUP BY conv_id, turn"""))
def b7(spark, sf):
    """B7 plain-text list of the first 5 active stores for every message with matches."""
    register(spark, sf)
    m = spark.table("messages").select("conv_id", "turn", "text")
    out = M.store_outcome(m, spark.table("locations"), spark.table("stores"), V["malay"], _ranked(spark))
    return P.render_store_list(out.filter(F.col("n_active") > 0)).select("conv_id", "turn", "store_list")
