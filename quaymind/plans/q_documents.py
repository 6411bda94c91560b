"""Document and conversation jobs: D1, D2, G9, W3, W4, W5, B8."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymind.operators import classify as C
from quaymind.operators import documents as D
from quaymind.plans import oracle_sql as O
from quaymind.plans.q_match import sections_sql
from quaymind.plans.registry import query
from quaymind.sources.fixtures import VOCABULARIES, register

V = VOCABULARIES


@query("d1_split_sections", O.sql(["faq_docs"], sections_sql("faq_docs"), """
SELECT doc_id, section, position, text FROM sections"""))
def d1(spark, sf):
    """D1 markdown sections of every conversation document (repeated headings replace, first position kept)."""
    register(spark, sf)
    return D.split_sections(spark.table("faq_docs")).select("doc_id", "section", "position", "text")


PARAS_SQL = """
SELECT conv_id AS doc_id, turn AS pos,
  CASE WHEN role = 'system' THEN 'Heading 1' WHEN turn % 5 = 4 THEN 'Heading 2'
       WHEN role = 'assistant' THEN 'List Paragraph' ELSE 'Normal' END AS style,
  CASE WHEN turn % 7 = 5 THEN '   ' WHEN role = 'system' THEN split_part(text, ' ', 1) ELSE text END AS text
FROM conversations"""


@query("d2_render_styled_paragraphs", O.sql([], [("paras", PARAS_SQL)] + [
    ("p", f"SELECT doc_id, pos, style, {O.strip('text')} AS t FROM paras WHERE {O.strip('text')} <> ''"),
    ("tag", """SELECT doc_id, pos, style = 'Heading 1' AS is_heading, CASE WHEN style = 'Heading 1' THEN t END AS name,
        CASE WHEN style = 'Heading 2' THEN concat(chr(10), '### ', t) WHEN style = 'List Paragraph' THEN concat('- ', t) ELSE t END AS line,
        sum(CASE WHEN style = 'Heading 1' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM p"""),
    ("body", "SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY pos) AS text FROM tag WHERE NOT is_heading GROUP BY doc_id, sec"),
    ("occ", """SELECT b.doc_id, b.sec, coalesce(h.name, 'General') AS section, b.text FROM body b
        LEFT JOIN (SELECT doc_id, sec, name FROM tag WHERE is_heading) h ON b.doc_id = h.doc_id AND b.sec = h.sec""")], """
SELECT doc_id, section, CAST(min(sec) AS BIGINT) AS position, arg_max(text, sec) AS text FROM occ GROUP BY doc_id, section"""))
def d2(spark, sf):
    """D2 styled paragraphs (derived from conversation turns) rendered into sections."""
    register(spark, sf)
    return D.render_styled_paragraphs(spark.sql(PARAS_SQL)).select("doc_id", "section", "position", "text")


@query("g9_transcript", O.sql(["history", "questions"], [
    ("h", f"SELECT conv_id, turn, {O.strip('text')} AS t FROM history WHERE {O.strip('text')} <> ''"),
    ("agg", "SELECT conv_id, list(t ORDER BY turn) AS lines FROM h GROUP BY conv_id"),
    ("tr", f"""SELECT a.conv_id, CASE WHEN {O.strip("coalesce(q.question, '')")} <> ''
          AND lower(a.lines[len(a.lines)]) = lower({O.strip('q.question')}) THEN list_slice(a.lines, 1, len(a.lines) - 1)
          ELSE a.lines END AS lines FROM agg a LEFT JOIN questions q USING (conv_id)""")], """
SELECT conv_id, CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) END AS transcript FROM tr"""))
def g9(spark, sf):
    """G9 transcript of every conversation up to its question (trailing copy of the question dropped)."""
    register(spark, sf)
    return D.transcript(spark.table("history"), questions=spark.table("questions"))


PAIRS_SQL = """
SELECT u.conv_id, u.turn, u.text AS user_text, coalesce(b.text, '') AS bot_text
FROM messages u LEFT JOIN messages b ON b.conv_id = u.conv_id AND b.turn = u.turn + 1 AND b.role = 'assistant'
WHERE u.role = 'user'"""


@query("w3_last_turns", O.sql(["messages"], [("pairs", PAIRS_SQL),
    ("last3", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM pairs)
        WHERE rn <= 3 AND length(user_text) > 0 AND length(bot_text) > 0"""),
    ("agg", """SELECT conv_id, string_agg(concat('User: ', user_text, chr(10), 'Bot: ', bot_text), chr(10) ORDER BY turn) AS h
        FROM last3 GROUP BY conv_id""")], """
SELECT DISTINCT p.conv_id, coalesce(a.h, '') AS history_text FROM pairs p LEFT JOIN agg a USING (conv_id)"""))
def w3(spark, sf):
    """W3 last three complete (user, bot) pairs of every conversation."""
    register(spark, sf)
    return D.last_turns(spark.sql(PAIRS_SQL))


# search plan per user turn: the search text is the message, a model on some turns
PLAN_SQL = """
SELECT conv_id, turn, text,
  CASE WHEN (conv_id + turn) % 3 = 1 THEN '' ELSE text END AS search_query,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN split_part(text, ' ', 1) ELSE '' END AS recommended_model
FROM messages WHERE role = 'user'"""


def _refine_sql():
    from quaymind.plans.q_classify import _any_sub
    return f"CASE WHEN len({O.tokens('text')}) = 0 THEN false ELSE {_any_sub(V['refinement'])} OR len({O.tokens('text')}) <= 4 END"


def _plan_df(spark):
    return spark.sql(PLAN_SQL).withColumn("is_refinement", C.is_refinement("text", V["refinement"]))


W4_CTES = [
    ("plan", PLAN_SQL),
    ("pl", f"""SELECT conv_id, turn, {O.strip('search_query')} AS sq, {O.strip('recommended_model')} AS md,
        {_refine_sql()} AS refine, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM plan"""),
    ("pl2", f"""SELECT *, CASE WHEN md <> '' THEN {O.strip("concat(md, ' ', sq)")} ELSE sq END AS own FROM pl"""),
    # the reference's loop, one turn per recursion step
    ("walk", f"""WITH RECURSIVE r(conv_id, n, turn, eff, last_eff) AS (
        SELECT conv_id, n, turn, e1, CASE WHEN e1 <> '' THEN e1 END FROM (
          SELECT conv_id, n, turn, own AS e1 FROM pl2 WHERE n = 1)
        UNION ALL
        SELECT conv_id, n, turn, e3, CASE WHEN e3 <> '' THEN e3 ELSE last_eff END FROM (
          SELECT p.conv_id, p.n, p.turn, r.last_eff,
            CASE WHEN (CASE WHEN p.refine AND r.last_eff IS NOT NULL AND p.md = '' THEN {O.strip("concat(r.last_eff, ' ', p.sq)")} ELSE p.own END) = ''
                  AND r.last_eff IS NOT NULL THEN r.last_eff
                 ELSE (CASE WHEN p.refine AND r.last_eff IS NOT NULL AND p.md = '' THEN {O.strip("concat(r.last_eff, ' ', p.sq)")} ELSE p.own END)
            END AS e3
          FROM r JOIN pl2 p ON p.conv_id = r.conv_id AND p.n = r.n + 1))
      SELECT conv_id, turn, eff FROM r"""),
]


@query("w4_carry_query", O.sql(["messages"], W4_CTES, "SELECT conv_id, turn, eff AS effective_query FROM walk"))
def w4(spark, sf):
    """W4 effective (carried) search query of every user turn."""
    register(spark, sf)
    return D.carry_query(_plan_df(spark)).select("conv_id", "turn", "effective_query")


HANDLES_SQL = """
SELECT conv_id, turn, text,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL
       ELSE [concat('model-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), concat('alt-', CAST(turn % 4 AS STRING))] END AS handles
FROM messages WHERE role = 'user'"""


@query("w5_carry_handles", O.sql(["messages"], [("hs", HANDLES_SQL.replace("STRING", "VARCHAR")),
    ("r", f"""SELECT conv_id, turn, {_refine_sql()} AS refine,
        last_value(handles IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hs""")], """
SELECT conv_id, turn, CASE WHEN refine THEN coalesce(array_to_string(prev, '|'), '') ELSE '' END AS preferred_handles FROM r"""))
def w5(spark, sf):
    """W5 preferred handles carried from the previous answered turn, on refinements."""
    register(spark, sf)
    df = spark.sql(HANDLES_SQL.replace("[", "array(").replace("] END", ") END")) \
        .withColumn("is_refinement", C.is_refinement("text", V["refinement"]))
    return D.carry_handles(df).select("conv_id", "turn",
                                      F.array_join("preferred_handles", "|").alias("preferred_handles"))


QA_SQL = """
SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS question,
       max(CASE WHEN role = 'assistant' THEN text END) AS answer
FROM messages GROUP BY conv_id"""


@query("b8_turns_from_qa", O.sql(["messages"], [("qa", QA_SQL)], f"""
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN array_to_string(list_filter([
    CASE WHEN {O.blank('question')} <> '' THEN concat('Customer: ', {O.blank('question')}) END,
    CASE WHEN {O.blank('answer')} <> '' THEN concat('Agent: ', {O.blank('answer')}) END], lambda x: x IS NOT NULL), chr(10))
  ELSE 'earlier turn' END AS history FROM qa"""))
def b8(spark, sf):
    """B8 history lines built from question/answer when the history is empty."""
    register(spark, sf)
    qa = spark.sql(QA_SQL).withColumn(
        "history", F.when(F.col("conv_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("earlier turn"))))
    out = D.turns_from_qa(qa)
    return out.select("conv_id", F.array_join("history", "\n").alias("history"))
