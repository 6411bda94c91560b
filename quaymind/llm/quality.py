"""Quality rules from cross-document line frequency.

Every line of a text is normalised (lower case, white space collapsed) and
hashed.  Digits stay: documents whose lines differ in numbers only are not
furniture.  Per host (the ``source`` column) the number of distinct
documents that hold a line is counted; exact copies of a text are one
document, so a popular document is not mistaken for page furniture.  A line is
removed when more than ``MIN_DOCUMENTS`` of them hold it, however large the
host, and a document is rejected when what remains of it is below
``MIN_WORDS`` words or below ``MIN_REMAINING`` of its words.  The base rules
(too few words, too much repetition inside the text) reject first.

Built-in column functions only.  Removed lines meet the documents' lines on
(host, line hash), so a hot host is spread over its lines; what each distinct
text loses goes back to the documents on (host, text hash).  Neither table is
bounded by the rule: each is broadcast when its measured size allows; beyond
that both sides are shuffled and Spark splits the document side of a hot line
or of a text with many copies.

Defined cases: null text has no words and fails the base rule; the null source
is a host of its own; an empty table gives no rows; repeated rows get equal
verdicts and count as one document; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymind.llm.common import BROADCAST_BYTES, DOC_COLUMNS, SPACE_CLASS, materialize, project, words

MIN_WORDS = 10
#: Words in repeated 5-word windows, in percent of all words.
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
#: A line is furniture when more distinct documents of its host than this hold it.
MIN_DOCUMENTS = 10
#: A document keeps at least this share of its words, or it is rejected.
MIN_REMAINING = 0.3


def repeated_words(tokens: Column, window: int = WINDOW_WORDS) -> Column:
    """Words that lie in windows of ``window`` words found twice or more in the text."""
    n = F.size(tokens)
    grams = F.slice(
        F.transform(tokens, lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, window)])),
        F.lit(1), F.greatest(n - window + 1, F.lit(0)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(marked: Column) -> Column:
            twice = F.filter(marked, lambda x, k: (x["h"] == F.get(marked, k - 1)["h"])
                             | (x["h"] == F.get(marked, k + 1)["h"]))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return _let(starts, lambda at: F.aggregate(
                F.transform(at, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - s, F.lit(window)))),
                F.lit(0).cast("long"), lambda a, x: a + x))

        return _let(placed, again)

    return F.when(n < window, F.lit(0).cast("long")).otherwise(
        _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
             .otherwise(covered(g))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_array(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(_strip(x)) > 0)


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(_strip(line)), SPACE_CLASS + "+", " ")


def with_stats(df: DataFrame) -> DataFrame:
    """``df`` with the base measures and, as ``lines``, (hash, words) of every line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = (df.withColumn("q_words", words(F.col("text")))
           .withColumn("q_lines", line_array(F.col("text"))))
    # space and the five controls are single characters: what is not one of them is in a word
    count = F.size("q_words").cast("long")
    return (out.withColumn("n_words", count)
            .withColumn("word_chars", F.length(F.array_join("q_words", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
            .withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
            .withColumn("n_repeat_words", repeated_words(F.col("q_words")))
            .withColumn("lines", F.transform("q_lines", lambda x: F.struct(
                F.xxhash64(normal_line(x)).alias("h"), F.size(words(x)).alias("n"))))
            .drop("q_words", "q_lines"))


def _met(table: DataFrame, size: Column) -> DataFrame:
    """``table`` as the small side of a join: broadcast when its measured size allows."""
    measured = table.agg(F.coalesce(F.sum(size + F.coalesce(F.octet_length("host"), F.lit(0)) + 32), F.lit(0))).first()[0]
    return F.broadcast(table) if measured <= BROADCAST_BYTES else table


def frequent_lines(lined: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """host and h, the hash, of every line above the limit.

    ``lined`` has the columns host, content (a hash of the whole text) and
    hashes (array of long).
    """
    return (lined.select("host", "content", F.explode(F.array_distinct("hashes")).alias("h")).distinct()
            .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents).select("host", "h"))


def removed_lines(lined: DataFrame) -> DataFrame:
    """host, content and, as ``removed``, the hashes of its frequent lines, for every text that has one.

    Two texts with one hash share a row: what it lists is frequent in their host, so each loses its own lines only.
    """
    frequent = materialize(frequent_lines(lined), "frequent-lines").select(F.col("host").alias("of"), F.col("h").alias("gone"))
    small = _met(frequent.withColumnRenamed("of", "host"), F.lit(8)).withColumnRenamed("host", "of")
    lines = lined.select("host", "content", F.explode(F.array_distinct("hashes")).alias("h"))
    held = lines.join(small, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("gone")))
    return held.groupBy("host", "content").agg(F.collect_set("h").alias("removed"))


def _attach_removed(df: DataFrame, lined: DataFrame) -> DataFrame:
    """``df`` (with ``source`` and ``content``) and the removed hashes of its text; empty where there are none."""
    removed = materialize(removed_lines(lined), "removed-lines").withColumnRenamed("content", "of")
    small = _met(removed, F.size("removed") * 8 + 8)
    out = df.join(small, F.col("source").eqNullSafe(F.col("host")) & F.col("content").eqNullSafe(F.col("of")), "left")
    return out.withColumn("removed", F.coalesce("removed", F.expr("array()").cast("array<bigint>"))).drop("host", "of")


def _verdict(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.aggregate("lines", F.lit(0).cast("long"),
                       lambda a, x: a + F.when(F.array_contains(F.col("removed"), x["h"]), 0).otherwise(x["n"]))
    remaining = F.when(F.size("removed") == 0, F.col("n_words")).otherwise(left)
    enough = (F.col("n_remaining") >= MIN_WORDS) & (F.col("n_remaining") >= F.col("n_words") * MIN_REMAINING)
    # one CASE over both sides of the join: a filter on it stays above the join, where the measures are plain
    # columns; split into conjuncts it would sink into the scan and compute them again in every place they are used
    return (df.withColumn("base_failed", failed).withColumn("n_remaining", remaining)
            .withColumn("kept", F.when(failed | F.col("removed").isNull(), F.lit(False)).otherwise(enough)))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, n_remaining, base_failed and kept; the texts are read once."""
    rows = project(docs, {"doc_id": "bigint", "text": "string", "source": "string"})
    slim = materialize(with_stats(rows.withColumn("content", F.xxhash64("text"))).drop("text"), "quality")
    lined = slim.select(F.col("source").alias("host"), "content", F.transform("lines", lambda x: x["h"]).alias("hashes"))
    return _verdict(_attach_removed(slim, lined)).drop("lines", "removed", "content", "source")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their frequent lines (n_chars follows the text)."""
    rows = project(docs, DOC_COLUMNS).withColumn("content", F.xxhash64("text"))
    lined = rows.select(F.col("source").alias("host"), "content",
                        F.transform(line_array(F.col("text")), lambda x: F.xxhash64(normal_line(x))).alias("hashes"))
    judged = _verdict(_attach_removed(with_stats(rows), materialize(lined, "quality-lines"))).where("kept")
    lines = F.filter(F.split("text", "\n", -1),
                     lambda x: ~F.array_contains(F.col("removed"), F.xxhash64(normal_line(x))))
    changed = F.size("removed") > 0
    return (judged.withColumn("text", F.when(changed, F.array_join(lines, "\n")).otherwise(F.col("text")))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*DOC_COLUMNS))


def op6_quality(docs: DataFrame) -> DataFrame:
    return score_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed", "kept")


_SQL_SPACE = "[\\x20\\x09-\\x0D]+"
_SQL_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Shared by the query's oracle and the pipeline's.
SQL_JUDGED = f"""
d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '{_SQL_SPACE}'), lambda x: x <> '') AS ws
      FROM documents),
ln AS (SELECT rid, source, text, unnest(string_split(t, chr(10))) AS line FROM d),
nl AS (SELECT *, regexp_replace(lower(trim(line, {_SQL_STRIP})), '{_SQL_SPACE}', ' ', 'g') AS norm,
              len(list_filter(regexp_split_to_array(line, '{_SQL_SPACE}'), lambda x: x <> '')) AS n FROM ln),
wl AS (SELECT * FROM nl WHERE n > 0),
held AS (SELECT source, norm, count(*) AS n FROM (SELECT DISTINCT source, norm, text FROM wl) GROUP BY source, norm),
gone AS (SELECT source, norm FROM held WHERE n > {MIN_DOCUMENTS}),
kept_words AS (SELECT wl.rid, sum(CASE WHEN gone.norm IS NULL THEN wl.n ELSE 0 END) AS n,
                      count(wl.line) - count(DISTINCT wl.line) AS dup
               FROM wl LEFT JOIN gone ON wl.source IS NOT DISTINCT FROM gone.source AND wl.norm = gone.norm
               GROUP BY wl.rid),
pos AS (SELECT rid, unnest(range(len(ws) - 4)) AS i, ws FROM d WHERE len(ws) >= 5),
gram AS (SELECT rid, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM pos),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM gram),
cover AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS k FROM twice WHERE c > 1),
rep AS (SELECT rid, sum(k) AS n FROM cover GROUP BY rid),
m AS (SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(kept_words.dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(kept_words.n, 0) AS n_left
      FROM d LEFT JOIN kept_words USING (rid) LEFT JOIN rep USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
                  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
                  AND n_left >= {MIN_WORDS} AND n_left >= n_words * {MIN_REMAINING} AS kept FROM m)
"""
ORACLE = f"""WITH {SQL_JUDGED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""
