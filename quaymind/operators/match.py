"""Matching joins: knowledge base (J3), stores (J4), earlier replies (J7),
FAQ sections (J8) and the routing / store-outcome compositions (P11, P12).

Skew notes: all joins but J4 have one side with at most one row per key
(pre-aggregated knowledge base, one question per conversation, one
section per (document, name)), so a hot key never multiplies rows; hot keys
on the big side are split by AQE's skew join when the small side is too
large to broadcast.  J4's result is message x matching store by definition.
Rows without a key stay out of the lookups' hot partition: they get keys of
their own that match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymind import fixed as X
from quaymind.functions.text import keywords, py_strip
from quaymind.functions.vocab import check_literal, lit_array
from quaymind.operators import classify as C
from quaymind.operators.substring import substring_pairs

PRODUCT_LABEL = X.PRODUCT_LABEL
BROADCAST_BYTES = 64 << 20  # of a dimension table shipped to every task
OUTRIGHT_PAIRS = 2_000_000  # needles x stores that are compared outright
TERM_CUTS = 8  # parts of a term's messages, and of its stores


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _spread(key: Column) -> Column:
    """The key, or one of 1024 texts that no key can be (they hold U+0000): rows
    without a key do not meet in one partition."""
    return F.coalesce(key, F.concat(F.lit("\x00none"), F.floor(F.rand(1) * 1024).cast("string")))


def kb_match(labels: DataFrame, kb: DataFrame, label: str = "match") -> DataFrame:
    """The first knowledge-base row (lowest ``ordinal``) whose trimmed
    keyword equals the label case-insensitively; NULL columns when none.
    The product label skips the lookup.

    The knowledge base is reduced to one row per normalised keyword before
    the join, so each label meets at most one row.
    """
    first = (kb.withColumn("_key", F.lower(py_strip(F.col("keyword"))))
             .groupBy("_key")
             .agg(F.min_by(F.struct("ordinal", "keyword", "answer"), F.col("ordinal")).alias("_kb")))
    lab = labels.withColumn("_lkey", _spread(F.when(F.col(label) != PRODUCT_LABEL, F.lower(F.col(label)))))
    out = lab.join(first, F.col("_lkey") == F.col("_key"), "left")
    return out.select(*labels.columns, F.col("_kb.ordinal").alias("kb_ordinal"),
                      F.col("_kb.keyword").alias("keyword"), F.col("_kb.answer").alias("answer"))


def term_stores(terms: DataFrame | None, dictionary: DataFrame, stores: DataFrame) -> DataFrame:
    """Precompute term -> matching stores, independent of message volume.

    Needles come from the dictionary (``term, needle``); a term missing from
    the dictionary is its own needle.  A store matches when its location or
    name contains a needle, any case.  Both inputs may have any size: beyond
    ``OUTRIGHT_PAIRS`` a gram index finds the stores (see ``substring``).
    """
    dict_needles = dictionary.select("term", "needle")
    if terms is None:  # terms come from the dictionary itself (P3 output): no unknown terms
        needles = dict_needles
    else:
        unknown = terms.select("term").distinct().join(dictionary.select("term").distinct(), "term", "left_anti") \
            .withColumn("needle", F.col("term"))
        needles = dict_needles.unionByName(unknown)
    needles = needles.withColumn("_n", F.lower("needle"))
    st = stores.withColumn("_loc", F.lower(F.coalesce("location", F.lit("")))) \
        .withColumn("_name", F.lower(F.coalesce("name", F.lit(""))))
    cond = (F.instr(F.col("_loc"), F.col("_n")) > 0) | (F.instr(F.col("_name"), F.col("_n")) > 0)
    # few pairs are compared outright, the needles broadcast; else the needles' rarest grams find the stores
    asked, size = needles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + F.octet_length("needle") + 64), F.lit(0))).head()
    if asked * stores.count() <= OUTRIGHT_PAIRS and size <= BROADCAST_BYTES:
        pairs = st.join(F.broadcast(needles), cond, "inner")
    else:
        # a needle may not reach over the seam: the condition is checked again
        st = st.withColumn("_tid", F.md5(F.concat_ws("\x00", "_loc", "_name")))
        texts = st.groupBy("_tid").agg(F.first(F.concat_ws("\x00", "_loc", "_name")).alias("text"))
        found = substring_pairs(texts, needles.select(F.col("_n").alias("needle")), "_tid").withColumnRenamed("needle", "_n")
        pairs = needles.join(found, "_n").join(st, "_tid").where(cond)
    return pairs.select("term", *stores.columns).dropDuplicates(["term", "id"])


def match_stores(messages: DataFrame, dictionary: DataFrame, stores: DataFrame,
                 term: str = "location_term", known_terms: bool = False) -> DataFrame:
    """Stores for each message's detected term (one row per message and
    store, with the P10 ``closed`` flag).  The message side meets the
    precomputed term->store table on an equi-join.  ``known_terms=True``
    (terms detected by P3) skips the unknown-term pass over the messages.

    Few terms may have most of the messages and of the stores, so a term's
    pairs are dealt over ``TERM_CUTS`` x ``TERM_CUTS`` cells of a message part
    and a store part each."""
    with_term = messages.filter(F.col(term).isNotNull())
    ts = term_stores(None if known_terms else with_term.select(F.col(term).alias("term")), dictionary, stores)
    ts = ts.select(F.col("term").alias(term), *[F.col(c).alias(f"store_{c}") if c != "id" else F.col("id").alias("store_id")
                                                for c in stores.columns])
    tasks = 4 * messages.sparkSession.sparkContext.defaultParallelism
    own = [c for c, t in messages.dtypes if "map<" not in t and "variant" not in t]
    part = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(TERM_CUTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(TERM_CUTS - 1))
    left = with_term.withColumn("_mine", part(*own)).withColumn("_theirs", F.explode(every))
    right = ts.withColumn("_theirs", part("store_id")).withColumn("_mine", F.explode(every))
    cell = [term, "_mine", "_theirs"]
    out = left.repartition(tasks, *cell).join(right.repartition(tasks, *cell), cell, "inner").drop("_mine", "_theirs")
    return out.withColumn("closed", C.is_closed("store_name"))


def history_reply(questions: DataFrame, turns: DataFrame, *, conv: str = "conv_id",
                  question: str = "question", order: str = "turn", text: str = "text") -> DataFrame:
    """For each question, the earlier turn sharing the most C2 keywords
    with it; ties go to the most recent turn; a trailing turn equal to the
    question (trimmed, any case) is ignored; no overlap -> NULL."""
    # the last turn by a window: the join with the questions and the aggregation reuse its partitioning
    t = (turns.filter(py_strip(F.col(text)) != "").select(conv, order, text)
         .withColumn("_last", F.max(order).over(Window.partitionBy(conv))))
    q = questions.select(conv, question).withColumn("_kq", keywords(F.col(question)))
    j = t.join(q, conv)
    dup = (F.col(order) == F.col("_last")) & \
        (F.lower(py_strip(F.col(text))) == F.lower(py_strip(F.col(question))))
    scored = j.filter(~dup).withColumn("_score", F.size(F.array_intersect(F.col("_kq"), keywords(F.col(text))))) \
        .filter(F.col("_score") > 0)
    best = scored.groupBy(conv).agg(F.max_by(py_strip(F.col(text)), F.struct("_score", order)).alias("reply"))
    return questions.join(best, conv, "left")


# Python str.splitlines() boundaries
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    """str.splitlines(): no trailing empty line after a final line break."""
    parts = F.split(text, LINE_BREAKS)
    ends = text.rlike("(" + LINE_BREAKS + ")$")
    return F.when(text == "", F.array().cast("array<string>")).when(
        ends, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def faq_section(messages: DataFrame, keyword_map: DataFrame, sections: DataFrame, *,
                text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Best FAQ section text per message.

    Score = number of the section's keyword phrases contained in the
    lowercased message; highest wins, ties go to keyword-map order.  Zero
    score, or a best section missing from the document, gives all sections
    of the document joined by a rule line.  The keyword map is small and
    is applied as literal expressions (no join); a section meets its
    messages on (document, section name), and a document's whole text only
    those messages that no section answers.
    """
    check_literal(keyword_map, "keyword", "the FAQ keyword map")
    rows = keyword_map.orderBy("ordinal", "keyword").collect()
    order: list[str] = []
    kw: dict[str, list[str]] = {}
    for r in rows:
        if r["section"] not in kw:
            order.append(r["section"])
            kw[r["section"]] = []
        kw[r["section"]].append(r["keyword"])
    low = F.lower(F.col(text))
    scored = F.array(*[F.struct(
        F.size(F.filter(lit_array(kw[s]), lambda k: F.instr(low, k) > 0)).alias("n"),
        F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(order)])
    best = F.array_max(scored)
    m = messages.withColumn("_best", F.when(best["n"] > 0, best["s"]))
    # a section is looked up by (document, name); the whole document only by the rows that need it
    named = sections.groupBy(F.col(doc).cast("string").alias("_doc"), F.col("section").alias("_name")).agg(
        F.min_by("text", F.struct("position", "text")).alias("_text"))
    key = F.when(F.col("_best").isNotNull(), F.col(doc).cast("string"))
    hit = m.withColumn("_key", _spread(key)).join(
        named, (F.col("_key") == F.col("_doc")) & (F.col("_best") == F.col("_name")), "left").drop("_doc", "_name", "_key")
    ordered = F.array_sort(F.collect_list(F.struct("position", "section", "text")))
    whole = sections.groupBy(F.col(doc).cast("string").alias("_doc")).agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), X.ALL_SECTIONS_SEP).alias("_all"))
    out = hit.withColumn("_key", _spread(F.when(F.col("_text").isNull(), F.col(doc).cast("string")))).join(
        whole, F.col("_key") == F.col("_doc"), "left")
    return out.select(*messages.columns, F.col("_best").alias("best_section"),
                      F.coalesce("_text", "_all").alias("faq_text"))


STORE_LOCATOR, STORE_NEEDS_LOCATION, FAQ = X.STORE_LOCATOR, X.STORE_NEEDS_LOCATION, X.FAQ


def _intercept(text: str, vocab: dict[str, list[str]], ranked_terms: list[str]) -> Column:
    loc = C.is_location_query(text, vocab["strong_location"], vocab["weak_location"], ranked_terms)
    term = C.location_term(text, ranked_terms)
    faq = C.is_faq_query(text, vocab["strong_faq"], vocab["weak_faq"])
    return (F.when(loc & term.isNull(), F.lit(STORE_NEEDS_LOCATION))
            .when(loc, F.lit(STORE_LOCATOR)).when(faq, F.lit(FAQ)))


def is_intercepted(text: str, vocab: dict[str, list[str]], ranked_terms: list[str]) -> Column:
    """Whether P11 routes the message by rule, without a label."""
    return _intercept(text, vocab, ranked_terms).isNotNull()


def route_messages(messages: DataFrame, replies: DataFrame, kb: DataFrame, vocab: dict[str, list[str]],
                   ranked_terms: list[str], *, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Location question -> STORE_LOCATOR / ..._NEEDS_LOCATION (score
    1.0); else FAQ question -> FAQ (1.0); else the routing model's label
    (C13 over ``replies.reply``) looked up in the knowledge base (J3).

    One pass: intercepted rows simply carry a NULL lookup key, so every
    message goes through the same (broadcastable) knowledge-base join."""
    from quaymind.functions.text import normalize_label
    keys = keys or ["conv_id", "turn"]
    intercept = _intercept(text, vocab, ranked_terms)
    m = messages.withColumn("_intercept", intercept)
    lab = replies.select(*keys, normalize_label(F.col("reply")).alias("_l"))
    j = m.join(lab, keys, "left")
    routed = (j.withColumn("match", F.coalesce(F.col("_intercept"), F.col("_l.match")))
               .withColumn("score", F.when(F.col("_intercept").isNotNull(), F.lit(1.0)).otherwise(F.col("_l.score")))
               .withColumn("_lookup", F.when(F.col("_intercept").isNull(), F.col("match")))
               .drop("_l"))
    looked = kb_match(routed, kb, "_lookup")
    return looked.withColumn("keyword", F.coalesce(F.col("_intercept"), F.col("keyword"))).drop("_intercept", "_lookup")


def term_outcomes(dictionary: DataFrame, stores: DataFrame, max_listed: int = 5) -> DataFrame:
    """Per dictionary term: active / closed store counts, and the first
    ``max_listed`` of each kind (store order).  Works on the dictionary x
    stores table, so messages only need a lookup by term; a term's stores are
    ranked, and only the listed ones are gathered."""
    ts = term_stores(None, dictionary, stores).withColumn("closed", C.is_closed("name"))
    nth = F.row_number().over(Window.partitionBy("term", "closed").orderBy("id", "name"))
    item = F.struct(F.col("id").alias("i"), F.col("name").alias("n"), F.col("location").alias("l"),
                    F.col("operatingHours").alias("h"), F.col("whatsappLink").alias("w"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(kind & (F.col("nth") <= max_listed), item)))
    return ts.withColumn("nth", nth).groupBy("term").agg(
        F.sum(F.when(~F.col("closed"), 1).otherwise(0)).cast("bigint").alias("n_active"),
        F.sum(F.when(F.col("closed"), 1).otherwise(0)).cast("bigint").alias("n_closed"),
        listed(~F.col("closed")).alias("active_stores"), listed(F.col("closed")).alias("closed_stores"))


def store_outcome(messages: DataFrame, dictionary: DataFrame, stores: DataFrame, malay: list[str],
                  ranked_terms: list[str] | Column, *, keys: list[str] | None = None, text: str = "text",
                  max_listed: int = 5, replies: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Per location message: language (P2), detected term (P3),
    needs_location when no term, active and closed store counts, the first
    ``max_listed`` stores of both kinds in store order (``active_stores``,
    ``active_names``, ``closed_names``) and the outcome kind (needs_location /
    not_found / stores).  ``replies`` maps (outcome, language) to the fixed
    text of the ``reply`` column, in which {term} is replaced.

    Store facts are aggregated per term first (bounded by the dictionary),
    then looked up by term; messages without a term meet no common key."""
    m = messages.withColumn("language", C.detect_language(text, malay)) \
        .withColumn("location_term", C.location_term(text, ranked_terms)) \
        .withColumn("_lkey", _spread(F.col("location_term")))
    per_term = term_outcomes(dictionary, stores, max_listed).withColumnRenamed("term", "_lkey")
    out = m.join(per_term, "_lkey", "left")
    n_act = F.coalesce("n_active", F.lit(0).cast("bigint"))
    n_clo = F.coalesce("n_closed", F.lit(0).cast("bigint"))
    none = F.array().cast(per_term.schema["active_stores"].dataType)
    act, clo = F.coalesce("active_stores", none), F.coalesce("closed_stores", none)
    outcome = (F.when(F.col("location_term").isNull(), F.lit("needs_location"))
               .when(n_act + n_clo == 0, F.lit("not_found")).otherwise(F.lit("stores")))
    reply = F.lit(None).cast("string")
    for (kind, language), said in (replies or {}).items():
        filled = F.replace(F.lit(said), F.lit("{term}"), F.coalesce("location_term", F.lit("")))
        reply = F.when((F.col("outcome") == kind) & (F.col("language") == language), filled).otherwise(reply)
    return out.select(
        *messages.columns, "language", "location_term",
        F.col("location_term").isNull().alias("needs_location"),
        n_act.alias("n_active"), n_clo.alias("n_closed"), act.alias("active_stores"),
        F.transform(act, lambda x: x["n"]).alias("active_names"),
        F.transform(clo, lambda x: x["n"]).alias("closed_names"), outcome.alias("outcome")).withColumn("reply", reply)
