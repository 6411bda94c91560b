"""Scalar text functions (C1-C17) as native Column expressions.

Every function takes and returns ``pyspark.sql.Column`` so it stays inside
whole-stage codegen; nothing here is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymind import fixed as X

__all__ = [
    "PY_WS", "py_strip", "tokens", "keywords", "word_set", "alnum_word_set",
    "model_tokens", "parse_price", "storage_key", "pretty_handle",
    "format_price", "compact_values", "phrase", "collapse_ws",
    "normalize_label", "normalize_emotion", "normalize_history_reply",
    "split_table_name", "price_line", "parse_query_plan", "str_or_blank",
]

# Python's str.strip()/\s whitespace set, written as a Java regex class
# (Java's \s alone is ASCII-only and lacks the \x1c-\x1f separators).
PY_WS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# every character Python's str.isspace() accepts (str.strip()'s default set)
PY_WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(col) -> Column:
    """str.strip(): remove leading/trailing whitespace of any kind
    (``btrim`` with Python's whitespace set; no regex)."""
    return F.btrim(_c(col), F.lit(PY_WS_CHARS))


def str_or_blank(col) -> Column:
    """``str(v or '').strip()`` for a string column: NULL -> ''."""
    return F.coalesce(py_strip(_c(col)), F.lit(""))


def tokens(col) -> Column:
    """Lowercase, split on ``[^a-z0-9]+``, keep tokens longer than 1."""
    return F.filter(F.split(F.lower(_c(col)), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def keywords(col) -> Column:
    """Distinct ``[a-z0-9']+`` tokens of the lowercased text, length > 2."""
    found = F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z0-9']+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 2))


def word_set(col) -> Column:
    """Distinct ``[a-z]+`` words of the lowercased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z]+)"), 1))


def alnum_word_set(col) -> Column:
    """C3 variant: distinct ``[a-z0-9]+`` words of the lowercased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z0-9]+)"), 1))


def model_tokens(col, stopwords: list[str]) -> Column:
    """C4: C1 tokens minus stopwords, first-seen order, no repeats.

    ``array_except`` keeps the left side's order and drops duplicates.
    """
    stop = F.array(*[F.lit(s) for s in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.array_except(tokens(col), stop)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_price(col) -> Column:
    """Strip, drop ',', blank -> NULL, drop 'RM'/'rm', float or NULL.

    Only plain decimal/exponent numbers parse; 'nan'/'inf' give NULL so a
    non-finite price can never win an ordering (documented difference).
    """
    raw = F.replace(py_strip(_c(col).cast("string")), F.lit(","), F.lit(""))
    raw = py_strip(F.replace(F.replace(raw, F.lit(X.CURRENCY), F.lit("")), F.lit(X.CURRENCY.lower()), F.lit("")))
    return F.when(raw.rlike(_NUMBER), raw.try_cast("double")).otherwise(F.lit(None).cast("double"))


def storage_key(col) -> Column:
    """struct(gb, text) ordering key for storage labels.

    First ``(\\d+)\\s*(tb|gb)?`` match; TB counts 1024 GB; no number or blank
    text sorts last (10**9); equal sizes order by the text itself.
    """
    text = F.lower(str_or_blank(col))
    qty = F.regexp_extract(text, r"(\d+)\s*(tb|gb)?", 1)
    unit = F.regexp_extract(text, r"(\d+)\s*(tb|gb)?", 2)
    huge = F.lit(2 ** 63 - 1).cast("bigint")  # beyond 64 bits: sorts after every real size
    gb = F.when(qty == "", F.lit(10 ** 9).cast("bigint")).otherwise(
        F.when(unit == "tb", F.coalesce(F.try_multiply(qty.try_cast("bigint"), F.lit(1024).cast("bigint")), huge))
         .otherwise(F.coalesce(qty.try_cast("bigint"), huge)))
    return F.struct(gb.alias("gb"), text.alias("text"))




def pretty_handle(col) -> Column:
    """Strip; blank -> 'Unknown model'; drop a '-flash-deal' suffix;
    split on '-' and capitalise each part (first upper, rest lower)."""
    raw = str_or_blank(col)
    body = F.regexp_replace(raw, X.FLASH_DEAL_SUFFIX + "$", "")
    parts = F.transform(F.split(body, "-"),
                        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))))
    return F.when(raw == "", F.lit(X.UNKNOWN_MODEL)).otherwise(F.array_join(parts, " "))


def format_price(col) -> Column:
    """C8: 'RM1,299' for whole amounts, else 'RM1,299.50'; NULL -> '-'.

    Input is a price value (text or number); it is parsed with C5 first.
    """
    x = parse_price(col)
    return (F.when(x.isNull(), F.lit(X.EMPTY_FIELD))
            .when(x == F.floor(x), F.concat(F.lit(X.CURRENCY), F.format_number(x, 0)))
            .otherwise(F.concat(F.lit(X.CURRENCY), F.format_number(x, 2))))


def compact_values(col) -> Column:
    """Drop blank and 'none' entries, distinct in first-seen order,
    joined by ' / '; an empty result is '-'."""
    kept = F.array_distinct(F.filter(F.transform(_c(col), lambda v: str_or_blank(v)),
                                     lambda v: (v != "") & (F.lower(v) != "none")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) <= 0, F.lit(X.EMPTY_FIELD)).otherwise(F.array_join(kept, X.VALUE_SEP))


def phrase(col) -> Column:
    """Lowercase, runs of non-alphanumerics -> one space, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", " "), F.lit(" "))


def collapse_ws(col) -> Column:
    """C11: whitespace runs -> one space, trimmed."""
    return F.btrim(F.regexp_replace(_c(col), f"{PY_WS}+", " "), F.lit(" "))


TICKET_LOGGED, LOG_TICKET, NO_MATCH = X.TICKET_LOGGED, X.LOG_TICKET, X.NO_MATCH
LOG_TICKET_SPELLINGS = X.LOG_TICKET_SPELLINGS


def normalize_label(col) -> Column:
    """Model reply -> struct(match, score).

    A JSON object reply gives ``match`` (default NO_MATCH) and ``score``;
    plain text is the match with score 0.  Ticket spellings (any case)
    normalise to TICKET_LOGGED / log_ticket.
    """
    reply = _c(col)
    parsed = F.try_parse_json(py_strip(reply))
    is_obj = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    json_match = F.coalesce(F.try_variant_get(parsed, "$.match", "string"), F.lit(NO_MATCH))
    match = py_strip(F.when(is_obj, json_match).otherwise(reply))
    score = F.when(is_obj, F.coalesce(F.try_variant_get(parsed, "$.score", "double"), F.lit(0.0))) \
        .otherwise(F.lit(0.0))
    up = F.upper(match)
    label = (F.when(up == TICKET_LOGGED, F.lit(TICKET_LOGGED))
             .when(up.isin(*LOG_TICKET_SPELLINGS), F.lit(LOG_TICKET))
             .otherwise(match))
    return F.struct(label.alias("match"), score.alias("score"))


EMOTIONS = X.EMOTIONS


def normalize_emotion(col) -> Column:
    """C14: JSON ``emotion`` lowercased, kept when in the whitelist, else ''."""
    parsed = F.try_parse_json(_c(col))
    emo = F.lower(F.try_variant_get(parsed, "$.emotion", "string"))
    return F.when(emo.isin(*EMOTIONS), emo).otherwise(F.lit(""))


def normalize_history_reply(col) -> Column:
    """Blank or 'no_match' (any case) -> NULL, else the trimmed reply."""
    m = py_strip(_c(col))
    return F.when((m == "") | (F.lower(m) == "no_match"), F.lit(None).cast("string")).otherwise(m)


def split_table_name(col) -> Column:
    """C16: 'schema.table' split at the first dot; default schema 'public'."""
    name = _c(col)
    has_dot = F.instr(name, ".") > 0
    return F.struct(
        F.when(has_dot, F.substring_index(name, ".", 1)).otherwise(F.lit(X.DEFAULT_SCHEMA)).alias("schema"),
        F.when(has_dot, F.substring(name, F.instr(name, ".") + 1, F.lit(1 << 30))).otherwise(name).alias("table"),
    )


def price_line(min_col, max_col) -> Column:
    """C17: 'a to b' / 'min a' / 'max b' / 'None' for the prompt."""
    lo, hi = _c(min_col), _c(max_col)
    los, his = lo.cast("string"), hi.cast("string")
    return (F.when(lo.isNotNull() & hi.isNotNull(), X.fill(X.PRICE_LINE_BOTH, lo=los, hi=his))
            .when(lo.isNotNull(), X.fill(X.PRICE_LINE_MIN, lo=los))
            .when(hi.isNotNull(), X.fill(X.PRICE_LINE_MAX, hi=his))
            .otherwise(F.lit(X.PRICE_LINE_NONE)))


def _price_field(parsed, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
    as_num = F.try_variant_get(parsed, f"$.{key}", "double")
    as_text = F.try_variant_get(parsed, f"$.{key}", "string")
    cleaned = py_strip(F.replace(as_text, F.lit(","), F.lit("")))
    from_text = F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double"))
    return (F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL"), as_num)
            .when(kind == "BOOLEAN", F.try_variant_get(parsed, f"$.{key}", "boolean").cast("double"))
            .when(kind == "STRING", from_text)
            .otherwise(F.lit(None).cast("double")))


def parse_query_plan(reply_col, query_col) -> Column:
    """Query-rewrite reply -> struct(search_query, recommended_model,
    price_min, price_max, error).

    A leading code fence is stripped (backticks off both ends, first 'json'
    removed).  Non-JSON or a non-object gives a row with ``error`` set
    instead of raising.
    """
    text = py_strip(F.coalesce(_c(reply_col), F.lit("")))
    fenced = text.startswith("```")
    unfenced = py_strip(F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), "^((?s).*?)json", "$1"))
    body = F.when(fenced, unfenced).otherwise(text)
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    is_obj = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    sq_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.search_query", "variant"))
    sq = py_strip(F.try_variant_get(parsed, "$.search_query", "string"))
    sq_ok = sq_kind.isNull() | (sq_kind == "STRING")
    search_query = F.when(F.coalesce(sq, F.lit("")) == "", py_strip(_c(query_col))).otherwise(sq)
    rm_kind = F.schema_of_variant(F.try_variant_get(parsed, "$.recommended_model", "variant"))
    model = F.when(rm_kind == "STRING", py_strip(F.try_variant_get(parsed, "$.recommended_model", "string"))) \
        .otherwise(F.lit(""))
    error = (F.when(~is_obj, F.concat(F.lit("non-JSON reply: "), body))
             .when(~sq_ok, F.lit("search_query is not a string")))
    ok = error.isNull()
    return F.struct(
        F.when(ok, search_query).alias("search_query"),
        F.when(ok, model).alias("recommended_model"),
        F.when(ok, _price_field(parsed, "price_min")).alias("price_min"),
        F.when(ok, _price_field(parsed, "price_max")).alias("price_max"),
        error.alias("error"),
    )
