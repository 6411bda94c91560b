"""Chat formatting of preference pairs.

A pair holds a chosen and a rejected conversation.  Their longest common turn
prefix (same role and same text, turn by turn) is rendered once as the prompt;
what follows on either side is rendered as a completion, with a mask of
[start, end) code point ranges that hold assistant content (and its end
marker): the rest of a completion carries no loss.

Built-in functions only.  Turns meet their conversation in one aggregation; a
conversation is one output row, so nothing larger than an output is gathered.

The table of conversations has no judged pairs, so the query derives them
without comparing conversations with each other: conversation c is chosen, and
rejected is c up to its last assistant turn, followed by the last assistant
turn of conversation c + 1 (by an equi-join on the id) and by c's own later
turns.  Where c + 1 has no assistant turn or is missing, the reply is empty.

Defined cases: turns are ordered by turn number, ties by role and text, null
turns first; null role and null text render as empty; turns with a null
conversation id belong to no conversation; repeated rows are repeated turns;
a conversation without assistant turns is all prompt with empty completions;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymind.llm.common import project

#: How a turn is written; {role} and {text} are replaced.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are the same in both arrays."""
    shorter = F.least(F.size(a), F.size(b))
    first = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (
        (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"])))
    return F.get(first, F.lit(0))


def _from(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.size(turns))


def _mask(turns: Column) -> Column:
    """The assistant content of a rendered completion, with its end marker."""
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")

    def step(a: Column, t: Column) -> Column:
        end = a["at"] + F.length(render(t))
        body = end - F.length(t["text"]) - len(CLOSE)
        # the last newline belongs to the format, not to the reply
        span = F.array(F.struct(body.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], span))
                        .otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    ``pairs`` has the columns ``chosen`` and ``rejected``, arrays of
    (role, text) in turn order.
    """
    def clean(turns: str) -> Column:
        return F.transform(F.coalesce(turns, F.expr("cast(array() as array<struct<role:string,text:string>>)")),
                           lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"),
                                              F.coalesce(t["text"], F.lit("")).alias("text")))

    df = pairs.select(F.col(id_col).alias("pair_id"), clean("chosen").alias("a"), clean("rejected").alias("b"))
    df = df.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    df = df.withColumns({"x": _from(F.col("a"), F.col("n")), "y": _from(F.col("b"), F.col("n"))})
    text = lambda turns: F.array_join(F.transform(turns, render), "")
    return df.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"),
                     text(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
                     text("x").alias("chosen"), _mask(F.col("x")).alias("chosen_mask"),
                     text("y").alias("rejected"), _mask(F.col("y")).alias("rejected_mask"))


def derived_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from a table of turns, as the module's text says."""
    turns = project(conversations, {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"})
    turns = turns.where(F.col("conv_id").isNotNull()).withColumns(
        {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    whole = (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
             .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("t")))
    said = F.filter("t", lambda x: x["role"] == "assistant")
    replies = whole.select((F.col("conv_id") - 1).alias("conv_id"), F.get(said, F.size(said) - 1)["text"].alias("reply"))
    df = whole.join(replies, "conv_id", "left")
    last = F.array_max(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i)))
    swapped = F.transform("t", lambda x, i: F.when(
        i == F.col("last"), F.struct(x["role"].alias("role"), F.coalesce("reply", F.lit("")).alias("text"))).otherwise(x))
    return (df.withColumn("last", last)
            .select(F.col("conv_id").alias("pair_id"), F.col("t").alias("chosen"), swapped.alias("rejected")))


def flat_pairs(pairs: DataFrame) -> DataFrame:
    """``format_pairs`` with the masks as text: ``start:end`` comma-joined."""
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return format_pairs(pairs).withColumns({"chosen_mask": flat("chosen_mask"), "rejected_mask": flat("rejected_mask")})


def op2_preferences(conversations: DataFrame) -> DataFrame:
    return flat_pairs(derived_pairs(conversations))


_RENDER = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id),
reply AS (SELECT t.conv_id, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.i = l.last),
meet AS (
  SELECT t.conv_id, t.i, t.role, t.text, l.last,
         CASE WHEN t.i = l.last THEN coalesce(reply.text, '') ELSE t.text END AS other
  FROM t JOIN l ON t.conv_id = l.conv_id LEFT JOIN reply ON reply.conv_id = t.conv_id + 1),
n AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE text <> other), count(*)) AS n FROM meet GROUP BY conv_id),
r AS (
  SELECT meet.conv_id, i, n, role, text, other, {_RENDER} AS ra, {_RENDER.replace('text', 'other')} AS rb
  FROM meet JOIN n ON meet.conv_id = n.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(ra)) FILTER (WHERE i >= n) OVER w, 0) AS ea,
            coalesce(sum(length(rb)) FILTER (WHERE i >= n) OVER w, 0) AS eb
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id AS pair_id, CAST(max(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(ra, '' ORDER BY i) FILTER (WHERE i < n), '') AS prompt,
       coalesce(string_agg(ra, '' ORDER BY i) FILTER (WHERE i >= n), '') AS chosen,
       coalesce(string_agg(CAST(ea - length(text) - 8 AS BIGINT) || ':' || CAST(ea - 1 AS BIGINT), ',' ORDER BY i)
                FILTER (WHERE i >= n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(rb, '' ORDER BY i) FILTER (WHERE i >= n), '') AS rejected,
       coalesce(string_agg(CAST(eb - length(other) - 8 AS BIGINT) || ':' || CAST(eb - 1 AS BIGINT), ',' ORDER BY i)
                FILTER (WHERE i >= n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
