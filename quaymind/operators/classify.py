"""Message classifiers (P2-P7, P10-P13): text -> label columns.

All classifiers are column expressions over literal vocabularies, so a
batch of messages is classified in one projection (no join, no shuffle).
P3 also has a table form that joins a dictionary of any size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymind.functions.text import alnum_word_set, py_strip, tokens, word_set
from quaymind.functions.vocab import check_literal, lit_array
from quaymind.operators.substring import rarest, substring_pairs
from quaymind import fixed as X

# word boundary as in Python's \b for word-like terms: no letter, digit or _
WB_L = r"(?<![\p{L}\p{N}_])"
WB_R = r"(?![\p{L}\p{N}_])"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_language(text, malay: list[str]) -> Column:
    """P2: 'ms' when at least 2 distinct [a-z]+ tokens are in the vocabulary."""
    hits = F.size(F.array_intersect(word_set(text), lit_array(malay)))
    return F.when(hits >= 2, F.lit("ms")).otherwise(F.lit("en"))


_WORD = re.compile(r"\w")


def location_pattern(term: str) -> str:
    """Java regex equal to Python's ``\\b + re.escape(term) + \\b``.

    Python's \\b before a word character needs a non-word (or start) before
    it, and before a non-word character needs a word character; the same on
    the right side.  Lookarounds express both without consuming text.
    """
    if not term:
        return "(?!)"
    left = WB_L if _WORD.match(term[0]) else r"(?<=[\p{L}\p{N}_])"
    right = WB_R if _WORD.match(term[-1]) else r"(?=[\p{L}\p{N}_])"
    return left + re.escape(term).replace("\\ ", " ") + right


def _ranked_terms(dictionary: DataFrame) -> list[str]:
    """Distinct terms ordered longest first, then dictionary order.

    The list becomes part of an expression, so its bytes are checked; a larger
    dictionary goes through ``detect_location``, whose result column the
    routing operators take in place of the list.
    """
    d = dictionary.groupBy("term").agg(F.min("ordinal").alias("ordinal"))
    check_literal(d, "term", "the location dictionary")
    return [r["term"] for r in d.orderBy(F.length("term").desc(), "ordinal").select("term").collect()]


def location_term(text, known: list[str] | Column) -> Column:
    """The detected term: from a ranked list, or the column that ``detect_location`` made."""
    if known is None:
        raise ValueError("no location terms: pass a list (empty for none) or the detected column")
    return known if isinstance(known, Column) else detect_location_expr(text, known)


_WORDLIKE = re.compile(r"^\w+( \w+)*$")
WORD_RUNS = r"[\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+)*"


def _ngrams(seqs: Column, max_n: int, firsts: dict[int, list[str]] | None = None) -> Column:
    """Word n-grams (n = 1..max_n) of every single-space-separated word run.

    With ``firsts`` (n -> first words of the n-word terms) an n-gram is only
    built where its first word can start a term; single words are the words
    themselves.  Without it every n-gram is built (join path).
    """
    def grams_of(n: int):
        # bind n outside the lambdas: Spark reads a 2-argument lambda as (x, index)
        def grams(s):
            w = F.split(s, " ")
            if n == 1:
                return w
            m = F.size(w)
            starts = F.filter(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda i: i <= m - n + 1)
            if firsts is not None:
                fw = lit_array(firsts.get(n, []))
                starts = F.filter(starts, lambda i: F.array_contains(fw, F.try_element_at(w, i)))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
        return grams

    ns = [n for n in range(1, max_n + 1) if firsts is None or n == 1 or firsts.get(n)]

    def all_grams(s):
        return F.flatten(F.array(*[grams_of(n)(s) for n in ns]))
    return F.flatten(F.transform(seqs, all_grams))


def detect_location_expr(text, ranked_terms: list[str]) -> Column:
    """P3 as one projection: the first (longest, then earliest) term found
    on word boundaries in the lowercased text; NULL when none.

    Word-like terms (words joined by single spaces) are found exactly by
    intersecting the text's word n-grams with the term list (a hash-set
    intersection).  Other terms use one compiled regex with a zero-width
    lookahead ``(?=(t1|t2|...))`` tried at every position, so overlapping
    candidates are all seen.  The best candidate by dictionary rank wins.
    """
    if not ranked_terms:
        return F.lit(None).cast("string")
    msg = F.lower(_c(text))
    rank = F.create_map(*[x for i, t in enumerate(ranked_terms) for x in (F.lit(t), F.lit(i))])
    wordlike = [t for t in ranked_terms if _WORDLIKE.match(t)]
    other = [t for t in ranked_terms if not _WORDLIKE.match(t)]
    cands = []
    if wordlike:
        max_n = max(len(t.split(" ")) for t in wordlike)
        firsts: dict[int, list[str]] = {}
        for t in wordlike:
            parts = t.split(" ")
            if len(parts) > 1 and parts[0] not in firsts.setdefault(len(parts), []):
                firsts[len(parts)].append(parts[0])
        grams = _ngrams(F.regexp_extract_all(msg, F.lit("(" + WORD_RUNS + ")"), 1), max_n, firsts)
        cands.append(F.array_intersect(grams, lit_array(wordlike)))
    if other:
        alt = "|".join(location_pattern(t) for t in other)
        cands.append(F.regexp_extract_all(msg, F.lit("(?=(" + alt + "))"), 1))
    found = cands[0] if len(cands) == 1 else F.concat(*cands)
    best = F.array_min(F.transform(found, lambda f: F.struct(F.try_element_at(rank, f).alias("r"), f.alias("t"))))
    return best["t"]


_WORD_CHAR = r"[\p{L}\p{N}_]"


def detect_location(df: DataFrame, text: str, dictionary: DataFrame, out: str = "location_term") -> DataFrame:
    """P3 over a message table, the same way for a dictionary of any size.

    A term is looked up by its rarest word: slim rows (digest of the text,
    word) meet the dictionary on equality.  A text's candidates come back to
    its rows by the digest, as one array that is checked on word boundaries in
    place, best first; so texts are never multiplied, and not moved at all
    while the candidates are small enough to be broadcast.  Terms without any
    word find their texts by character grams (``substring_pairs``).  Every
    message row keeps its own result, also where rows are equal; rows with a
    null text have none.  A text's array is as long as the terms whose rarest
    word it holds.
    """
    msg = F.lower(F.col(text))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(_WORD_CHAR + "+"), F.lit(0)))
    d = (dictionary.where(F.col("term") != "").groupBy("term").agg(F.min("ordinal").alias("_ord"))
         .withColumn("_words", words(F.col("term"))))
    texts = df.select(F.md5(msg).alias("_tid"), msg.alias("_text")).where(F.col("_text").isNotNull())
    parts = d.select("term", F.explode("_words").alias("_word"))
    index = (texts.select("_tid", F.explode(words(F.col("_text"))).alias("_word"))
             .join(parts.select("_word").distinct(), "_word", "left_semi").distinct())
    found = rarest(parts, index, "term", "_word").join(index, "_word").select("term", "_tid")
    wordless = d.where(F.size("_words") == 0).select("term")
    if wordless.limit(1).count():
        found = found.unionByName(substring_pairs(texts.distinct(), wordless, "_tid", "_text", "term"))
    ranked = F.struct((-F.length("term")).alias("n"), F.col("_ord").alias("o"), F.col("term").alias("t"))
    per_text = found.join(d, "term").groupBy("_tid").agg(F.sort_array(F.collect_list(ranked)).alias("_terms"))

    def holds(term: Column) -> Column:
        edge = lambda at, inside, outside: F.when(term.rlike(at), F.lit(outside)).otherwise(F.lit(inside))
        quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.regexp_like(msg, F.concat(edge("^" + _WORD_CHAR, f"(?<={_WORD_CHAR})", WB_L), quoted,
                                           edge(_WORD_CHAR + "$", f"(?={_WORD_CHAR})", WB_R)))
    # rows without a text get keys of their own that match nothing, so they do not meet in one partition
    key = F.coalesce(F.md5(msg), F.concat(F.lit("none"), F.floor(F.rand(1) * 1024).cast("string")))
    best = F.get(F.filter("_terms", lambda x: holds(x["t"])), F.lit(0))["t"]
    return (df.withColumn("_key", key).join(per_text, F.col("_key") == F.col("_tid"), "left")
            .select(*df.columns, best.alias(out)))


def is_location_query(text, strong: list[str], weak: list[str], ranked_terms: list[str] | Column) -> Column:
    """Any strong token; or 2+ distinct weak tokens; or <= 6 distinct
    tokens and a known location (P3)."""
    toks = word_set(text)
    return (F.arrays_overlap(toks, lit_array(strong)).eqNullSafe(True)
            | (F.size(F.array_intersect(toks, lit_array(weak))) >= 2)
            | ((F.size(toks) <= 6) & location_term(text, ranked_terms).isNotNull()))


def is_faq_query(text, strong: list[str], weak: list[str]) -> Column:
    """P5: a strong signal as a substring of the lowercased text with '-' and
    ' ' removed (it may span words), or 2+ distinct weak [a-z0-9]+ tokens."""
    squashed = F.replace(F.replace(F.lower(_c(text)), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    strong_hit = F.exists(lit_array(strong), lambda s: F.instr(squashed, s) > 0)
    weak_hits = F.size(F.array_intersect(alnum_word_set(text), lit_array(weak)))
    return F.coalesce(strong_hit, F.lit(False)) | (weak_hits >= 2)


GREETING_REPLY, TICKET_LOGGED, LOG_TICKET = X.GREETING_REPLY, X.TICKET_LOGGED, X.LOG_TICKET


def detect_escalation(text, greeting: list[str], logged: list[str], human: list[str],
                      ticket: list[str]) -> Column:
    """struct(escalate, response).  Lowercased, not stripped.  Order:
    greeting (equal, or term + space prefix) -> fixed greeting reply;
    ticket-logged substring -> TICKET_LOGGED; human substring -> log_ticket;
    ticket substring -> log_ticket; else (false, '')."""
    t = F.lower(_c(text))
    greet = F.exists(lit_array(greeting), lambda g: (t == g) | t.startswith(F.concat(g, F.lit(" "))))
    has = lambda words: F.exists(lit_array(words), lambda w: F.instr(t, w) > 0)
    resp = (F.when(greet, F.lit(GREETING_REPLY))
            .when(has(logged), F.lit(TICKET_LOGGED))
            .when(has(human), F.lit(LOG_TICKET))
            .when(has(ticket), F.lit(LOG_TICKET))
            .otherwise(F.lit("")))
    return F.struct((resp != "").alias("escalate"), resp.alias("response"))


def is_refinement(text, terms_: list[str]) -> Column:
    """False without 2+ char tokens; true when any term is a substring of
    the lowercased text, or there are at most 4 tokens (repeats counted)."""
    t = F.lower(_c(text))
    toks = tokens(t)
    sub = F.exists(lit_array(terms_), lambda w: F.instr(t, w) > 0)
    return F.coalesce(F.when(F.size(toks) == 0, F.lit(False)).otherwise(sub | (F.size(toks) <= 4)),
                      F.lit(False))


def is_closed(name) -> Column:
    """P10: a store is closed when its name contains the closed marker (any case)."""
    return F.coalesce(F.instr(F.lower(_c(name)), X.CLOSED_MARKER.lower()) > 0, F.lit(False))


def split_open_closed(stores: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """P10 as two DataFrames (active, closed)."""
    flagged = stores.withColumn("closed", is_closed(name))
    return flagged.filter(~F.col("closed")), flagged.filter(F.col("closed"))


EMPTY_QUESTION, HISTORY_NOT_LIST = X.EMPTY_QUESTION, X.HISTORY_NOT_LIST


def validation_reason(question, history: str | None = None) -> Column:
    """Reject reason instead of an HTTP 400 (NULL when valid): the
    question must be a non-blank string; history, when given, an array."""
    q = _c(question)
    reason = F.when(q.isNull() | (py_strip(q.cast("string")) == ""), F.lit(EMPTY_QUESTION))
    if history is not None:
        reason = reason.when(F.col(history).isNull(), F.lit(HISTORY_NOT_LIST))
    return reason


def split_valid(df: DataFrame, question: str, history: str | None = None) -> tuple[DataFrame, DataFrame]:
    r = df.withColumn("reject_reason", validation_reason(question, history))
    return r.filter(F.col("reject_reason").isNull()).drop("reject_reason"), r.filter(F.col("reject_reason").isNotNull())
