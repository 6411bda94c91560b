"""Document and conversation operators: FAQ sections (D1, D2), transcripts
(G9), conversation memory (W3), carried search state (W4, W5) and Q/A turns
(B8).

Ordered per-document / per-conversation state uses window functions over
(doc or conversation, position) -- the declarative form of the reference's
loops -- and aggregations with partial (map-side) combine where only a
summary is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymind import fixed as X
from quaymind.functions.text import py_strip
from quaymind.operators.match import split_lines

GENERAL = X.GENERAL_SECTION


def _sections_from_lines(lines: DataFrame, doc: str) -> DataFrame:
    """lines: doc, pos, is_heading, name (heading name or NULL), line.

    A heading opens a section; lines before the first heading form
    'General'; a section is kept only when it has at least one line; a
    repeated name keeps the later text at the first position.
    """
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = lines.withColumn("sec", F.sum(F.col("is_heading").cast("int")).over(w))
    body = F.when(~F.col("is_heading"), F.struct("pos", "line"))
    # one aggregation per (doc, section id): heading name and body lines together
    # (the window's doc partitioning already clusters these groups: no new shuffle)
    occ = (tagged.groupBy(doc, "sec")
           .agg(F.max(F.when(F.col("is_heading"), F.col("name"))).alias("_name"),
                F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("text"),
                F.count(body).alias("_n"))
           .filter(F.col("_n") > 0)
           .withColumn("section", F.coalesce(F.col("_name"), F.lit(GENERAL))))
    return occ.groupBy(doc, "section").agg(
        F.min("sec").alias("position"), F.max_by("text", "sec").alias("text"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(lines: Column, marker: str) -> Column:
    """The sections of one document's lines: array of (section, position, text), one per name.

    Linear in the lines but for a sort of the headings: their places cut the
    lines into bodies; ordered by (name, number), the first of a name gives
    the position and the last one the text.
    """
    heads = F.filter(F.transform(lines, lambda line, i: F.when(line.startswith(marker), i)), lambda i: i.isNotNull())

    def cut(at: Column) -> Column:
        def section(start: Column, n: Column) -> Column:
            end = F.coalesce(F.get(at, n + 1), F.size(lines))
            name = F.when(n == 0, F.lit(GENERAL)).otherwise(
                py_strip(F.substring(F.get(lines, start), F.lit(len(marker) + 1), F.lit(1 << 30))))
            return F.struct(name.alias("section"), n.alias("n"), F.slice(lines, start + 2, end - start - 1).alias("body"))
        return F.array_sort(F.filter(F.transform(at, section), lambda s: F.size(s["body"]) > 0))

    def one_per_name(ordered: Column) -> Column:
        # a whole array per condition: filter hands over the element and its place
        first = F.filter(ordered, lambda s, i: ~s["section"].eqNullSafe(F.get(ordered, i - 1)["section"]))
        last = F.filter(ordered, lambda s, i: ~s["section"].eqNullSafe(F.get(ordered, i + 1)["section"]))
        return F.zip_with(first, last, lambda a, z: F.struct(
            z["section"].alias("section"), a["n"].cast("bigint").alias("position"), F.array_join(z["body"], "\n").alias("text")))
    return _let(F.concat(F.array(F.lit(-1)), heads), lambda at: _let(cut(at), one_per_name))


def split_sections(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", marker: str = X.SECTION_MARKER) -> DataFrame:
    """Markdown-style sections of each document: ``doc, section,
    position, text`` (lines split as str.splitlines).

    A document is a row and is folded where it lies: nothing is shuffled.  A
    heading opens a section; lines before the first heading form 'General'; a
    section is kept only when it has a line; a repeated name keeps the later
    text at the first position.  Null and empty texts have no section."""
    folded = docs.select(doc, _let(split_lines(F.col(text)), lambda lines: _fold(lines, marker)).alias("_sections"))
    return folded.select(doc, F.inline("_sections"))


HEADING_1, HEADING_2, LIST_STYLE = X.HEADING_1, X.HEADING_2, X.LIST_STYLE


def render_styled_paragraphs(paras: DataFrame, *, doc: str = "doc_id", pos: str = "pos",
                             style: str = "style", text: str = "text") -> DataFrame:
    """Styled paragraphs -> sections.  Heading 1 opens a section; heading
    2 becomes '\\n### text', list paragraphs '- text'; blank paragraphs are
    dropped (text stripped)."""
    t = py_strip(F.col(text))
    p = paras.withColumn("_t", t).filter(F.col("_t") != "")
    line = (F.when(F.col(style) == HEADING_2, F.concat(F.lit(X.HEADING_2_PREFIX), F.col("_t")))
            .when(F.col(style) == LIST_STYLE, F.concat(F.lit(X.LIST_PREFIX), F.col("_t")))
            .otherwise(F.col("_t")))
    lines = p.select(doc, F.col(pos).alias("pos"), (F.col(style) == HEADING_1).alias("is_heading"),
                     F.when(F.col(style) == HEADING_1, F.col("_t")).alias("name"), line.alias("line"))
    return _sections_from_lines(lines, doc)


def transcript(turns: DataFrame, *, conv: str = "conv_id", order: str = "turn", text: str = "text",
               questions: DataFrame | None = None, question: str = "question",
               previous: DataFrame | None = None, summary: str = "previous_summary") -> DataFrame:
    """Non-blank trimmed turns in order joined by newline, per
    conversation.  With ``questions``, a trailing turn equal to the question
    (any case) is dropped.  An empty transcript is NULL, or the stripped
    previous summary when ``previous`` is given."""
    t = turns.filter(py_strip(F.col(text)) != "").withColumn("_t", py_strip(F.col(text)))
    agg = t.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t"))))
                              .alias("_items"))
    lines = F.transform(F.col("_items"), lambda x: x["t"])
    if questions is not None:
        agg = agg.join(questions.select(conv, question), conv, "left")
        last = F.try_element_at(lines, F.lit(-1))
        drop = F.coalesce(F.lower(last) == F.lower(py_strip(F.col(question))), F.lit(False)) & \
            (py_strip(F.coalesce(F.col(question), F.lit(""))) != "")
        lines = F.when(drop, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    agg = agg.withColumn("_lines", lines)
    out = agg.select(conv, F.when(F.size("_lines") > 0, F.array_join("_lines", "\n")).alias("transcript"))
    if previous is not None:
        out = previous.select(conv, summary).join(out, conv, "full") \
            .select(conv, F.coalesce(F.col("transcript"), py_strip(F.col(summary))).alias("transcript"))
    return out


def last_turns(pairs: DataFrame, n: int = 3, *, conv: str = "conv_id", order: str = "turn",
               user: str = "user_text", bot: str = "bot_text") -> DataFrame:
    """The last n (user, bot) pairs of each conversation; pairs with an
    empty side are then dropped; rendered 'User: ..\\nBot: ..' lines.
    ``row_number() <= n`` is planned as a partial + final WindowGroupLimit."""
    w = Window.partitionBy(conv).orderBy(F.col(order).desc())
    last = pairs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    full = last.filter((F.coalesce(F.length(user), F.lit(0)) > 0) & (F.coalesce(F.length(bot), F.lit(0)) > 0))
    item = F.struct(F.col(order).alias("o"), X.fill(X.MEMORY_PAIR, user=F.col(user), bot=F.col(bot)).alias("t"))
    agg = full.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n")
                                 .alias("history_text"))
    return pairs.select(conv).distinct().join(agg, conv, "left") \
        .select(conv, F.coalesce("history_text", F.lit("")).alias("history_text"))


def carry_query(turns: DataFrame, *, conv: str = "conv_id", order: str = "turn",
                search: str = "search_query", model: str = "recommended_model",
                refine: str = "is_refinement") -> DataFrame:
    """Effective search query per turn.

    own = 'model search' (stripped) when a model is given, else the search
    text.  A refinement without a model appends its search text to the
    previous effective query; a blank effective query repeats the previous
    one.  Expressed as reset groups: a turn resets when its own text is
    non-blank and it is not a refinement (or nothing came before it); the
    effective query is the group's base plus every appended piece so far.
    """
    sq = py_strip(F.coalesce(F.col(search), F.lit("")))
    md = py_strip(F.coalesce(F.col(model), F.lit("")))
    own = F.when(md != "", py_strip(F.concat(md, F.lit(" "), sq))).otherwise(sq)
    ref = F.coalesce(F.col(refine), F.lit(False)) & (md == "")
    t = turns.withColumn("_own", own).withColumn("_ref", ref)
    running = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_prior", F.coalesce(F.max((F.col("_own") != "").cast("int")).over(before), F.lit(0)) > 0)
    reset = (F.col("_own") != "") & (~F.col("_ref") | ~F.col("_prior"))
    t = t.withColumn("_reset", reset).withColumn("_g", F.sum(F.col("_reset").cast("int")).over(running))
    piece = F.when(F.col("_reset"), F.col("_own")).when(F.col("_ref") & (F.col("_g") > 0), sq).otherwise(F.lit(""))
    grp = Window.partitionBy(conv, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_pieces", F.collect_list(F.when(piece != "", piece)).over(grp))
    eff = F.when(F.col("_g") == 0, F.lit("")).otherwise(F.array_join("_pieces", " "))
    return t.withColumn("effective_query", eff).drop("_own", "_ref", "_prior", "_reset", "_g", "_pieces")


def carry_handles(turns: DataFrame, *, conv: str = "conv_id", order: str = "turn",
                  handles: str = "handles", refine: str = "is_refinement") -> DataFrame:
    """Preferred handles = handles shown on the previous answered turn
    (``handles`` not NULL), only when the current turn is a refinement;
    unanswered turns do not clear them."""
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.col(handles), ignorenulls=True).over(before)
    pref = F.when(F.coalesce(F.col(refine), F.lit(False)), F.coalesce(prev, F.array().cast("array<string>"))) \
        .otherwise(F.array().cast("array<string>"))
    return turns.withColumn("preferred_handles", pref)


def turns_from_qa(df: DataFrame, *, key: str = "conv_id", history: str = "history",
                  question: str = "question", answer: str = "answer") -> DataFrame:
    """When the history is empty, build 'Customer: q' / 'Agent: a' turns
    from the non-blank question and answer; otherwise keep the history."""
    q = py_strip(F.coalesce(F.col(question), F.lit("")))
    a = py_strip(F.coalesce(F.col(answer), F.lit("")))
    built = F.array_compact(F.array(F.when(q != "", F.concat(F.lit(X.CUSTOMER_PREFIX), q)),
                                    F.when(a != "", F.concat(F.lit(X.AGENT_PREFIX), a))))
    empty = F.coalesce(F.size(F.col(history)), F.lit(0)) <= 0
    return df.withColumn(history, F.when(empty, built).otherwise(F.col(history)))
