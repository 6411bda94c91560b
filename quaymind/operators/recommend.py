"""Recommendation operators: record lookup (J1/J2), price filter (P1),
model grouping (G7/G8), model/mention filters (J5/J6/P8), links (B4),
cards (B5), ranked-hit helpers (W1, S1-S4) and the conversation carry
operators (W3-W5).

Grouping is always per query and bounded by the k candidates of the search,
so no group can grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymind import fixed as X
from quaymind.functions.text import (
    compact_values, format_price, parse_price, phrase, pretty_handle,
    storage_key, str_or_blank, tokens,
)

KEYS = ["product_id", "variant_id"]
RECORD_FIELDS = ["vendor", "product_type", "handle", "color", "spec", "condition", "tenure", "price"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup_records(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows for the given (product_id, variant_id) keys.

    Inner equi-join; duplicate keys are reduced first so the key side can be
    the small build side (Catalyst/AQE broadcast it when its size allows).
    """
    return catalog.join(keys.select(*KEYS).dropDuplicates(KEYS), KEYS, "inner")


def attach_records(hits: DataFrame, records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Left lookup of record fields for each hit; hits whose record is
    missing or has a blank handle are dropped (so Catalyst may plan it as
    an inner join).  The handle is cleaned on the record side, before the
    join, so the work scales with the catalog, not with the hits."""
    fields = [c for c in RECORD_FIELDS if c in records.columns] + list(extra or [])
    rec = records.select(*KEYS, *fields).withColumn("handle", str_or_blank("handle"))
    out = hits.join(rec, KEYS, "left")
    return out.filter(F.col("handle").isNotNull() & (F.col("handle") != ""))


def price_filter(df: DataFrame, price: Column | str = "price", price_min=None, price_max=None,
                 parsed: bool = False) -> DataFrame:
    """Keep a row when its price does not parse, or min <= p < max.

    ``price_min`` / ``price_max`` are column names, Columns or literals;
    NULL bounds are open.  The max bound is exclusive.  ``parsed=True``
    means ``price`` already holds the C5-parsed number.
    """
    p = _c(price) if parsed else parse_price(price)
    lo = F.lit(None).cast("double") if price_min is None else (
        _c(price_min) if isinstance(price_min, (str, Column)) else F.lit(float(price_min)))
    hi = F.lit(None).cast("double") if price_max is None else (
        _c(price_max) if isinstance(price_max, (str, Column)) else F.lit(float(price_max)))
    keep = p.isNull() | ((lo.isNull() | (p >= lo)) & (hi.isNull() | (p < hi)))
    return df.filter(keep)


def ordered_distinct(value: Column, order: Column) -> Column:
    """G8 (aggregate form): distinct non-blank values in first-seen order.

    Use inside ``groupBy().agg``; groups here are bounded by the caller.
    """
    v = str_or_blank(value)
    items = F.collect_list(F.when(v != "", F.struct(order.alias("o"), v.alias("v"))))
    return F.array_distinct(F.transform(F.array_sort(items), lambda x: x["v"]))


def ordered_distinct_df(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """G8 (table form): pre-aggregates (key, value) -> min(order) so the
    per-key list only holds distinct values, then orders it."""
    v = str_or_blank(value)
    firsts = (df.withColumn("_v", v).filter(F.col("_v") != "")
              .groupBy(key, "_v").agg(F.min(order).alias("_o")))
    return firsts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col("_v")))),
                    lambda x: x["_v"]).alias("values"))


def sorted_storage(values: Column) -> Column:
    """Sort distinct storage labels by C6 (size, text), stable on first-seen order."""
    keyed = F.transform(values, lambda x, i: F.struct(storage_key(x).alias("k"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def product_link(handle: Column | str, domain: Column | str) -> Column:
    """B4: 'https://<domain>/products/<handle>'; '' when the domain is blank."""
    d = F.regexp_replace(F.replace(F.replace(_c(domain) if isinstance(domain, Column) else F.lit(domain),
                                             F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")),
                         "^/+|/+$", "")
    d = F.regexp_replace(d, "^\\s+|\\s+$", "")
    return F.when(d == "", F.lit("")).otherwise(
        X.fill(X.PRODUCT_LINK, domain=d, handle=F.coalesce(_c(handle), F.lit(""))))


def variant_link(handle: Column | str, variant_id: Column | str, domain: Column | str) -> Column:
    """Product link + '?variant=<id>'; '' when no link or the id is falsy."""
    pl = product_link(handle, domain)
    vid = _c(variant_id)
    return F.when((pl == "") | vid.isNull() | (vid == 0), F.lit("")).otherwise(
        F.concat(pl, X.fill(X.VARIANT_SUFFIX, variant_id=vid.cast("string"))))


def diverse_models(hits: DataFrame, records: DataFrame, k: int = 3, *,
                   query_id: str = "query_id", price_min=None, price_max=None,
                   preferred: str | None = None, domain: str = "") -> DataFrame:
    """Group ranked hits by model handle and keep the first k models.

    Per (query, handle), after J2 and P1: ``rank`` = first (minimum) hit
    rank; best variant = highest score, then lowest non-NULL price, then
    lowest rank; ``from_price`` = lowest parsed price; storage options
    distinct and sorted by C6; condition and colour options distinct in
    first-seen order.  Preferred handles (array column ``preferred``) come
    first, then first-seen order; ``position`` numbers the kept models.
    """
    rows = attach_records(hits, records.withColumn("_p", parse_price("price")), extra=["_p"])
    rows = price_filter(rows, "_p", price_min, price_max, parsed=True)
    inf = F.lit(float("inf"))
    pref = (F.coalesce(F.array_contains(F.col(preferred), F.col("handle")), F.lit(False))
            if preferred else F.lit(False))
    rows = rows.withColumn("_pref", pref)
    best = F.min_by(
        F.struct(*[F.col(c) for c in KEYS], "color", "spec", "condition", "tenure", "price",
                 F.col("score").alias("score")),
        F.struct((-F.col("score")).alias("s"), F.coalesce(F.col("_p"), inf).alias("p"), F.col("rank").alias("r")))
    g = rows.groupBy(query_id, "handle").agg(
        F.min("rank").alias("first_rank"),
        best.alias("best"),
        F.min("_p").alias("from_price"),
        sorted_storage(ordered_distinct(F.col("spec"), F.col("rank"))).alias("storage_options"),
        ordered_distinct(F.col("condition"), F.col("rank")).alias("condition_options"),
        ordered_distinct(F.col("color"), F.col("rank")).alias("color_options"),
        F.max("_pref").alias("preferred"),
    )
    w = Window.partitionBy(query_id).orderBy(F.col("preferred").desc(), F.col("first_rank"))
    top = g.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k) \
        .withColumn("position", F.col("position").cast("long"))
    return top.select(
        query_id, "position", F.col("first_rank").alias("rank"), "handle",
        F.col("best.product_id").alias("product_id"), F.col("best.variant_id").alias("variant_id"),
        F.col("best.color").alias("color"), F.col("best.spec").alias("spec"),
        F.col("best.condition").alias("condition"), F.col("best.tenure").alias("tenure"),
        F.col("best.price").alias("price"), F.col("best.score").alias("best_score"),
        "from_price", "storage_options", "condition_options", "color_options", "preferred",
        variant_link(F.col("handle"), F.col("best.variant_id"), domain).alias("variant_link"),
        product_link(F.col("handle"), domain).alias("product_link"),
    )


def handle_matches_model(model_tokens: Column, handle: Column | str) -> Column:
    """Does a handle name the model?  Numeric model tokens must all be
    in the handle; up to 3 tokens all must be present; more need
    ``max(2, floor((3n+3)/4))`` hits."""
    ht = tokens(_c(handle))
    n = F.size(model_tokens)
    hits = F.size(F.filter(model_tokens, lambda t: F.array_contains(ht, t)))
    numeric_ok = F.forall(model_tokens, lambda t: ~t.rlike("^[0-9]+$") | F.array_contains(ht, t))
    enough = F.when(n <= 3, hits == n).otherwise(hits >= F.greatest(F.lit(2), F.floor((n * 3 + 3) / 4)))
    return F.coalesce((F.size(ht) > 0) & (n > 0) & numeric_ok & enough, F.lit(False))


def semi_or_all_by_model(rows: DataFrame, model: str, stopwords: list[str], *,
                         query_id: str = "query_id", handle: str = "handle") -> DataFrame:
    """Per query keep only rows whose handle matches the recommended
    model (column ``model``) when any does, else keep all; adds
    ``recommended_in_results``.  Blank model or no tokens keeps all."""
    from quaymind.functions.text import model_tokens
    mt = model_tokens(F.coalesce(F.col(model), F.lit("")), stopwords)
    m = handle_matches_model(mt, F.lower(str_or_blank(handle)))
    w = Window.partitionBy(query_id)
    out = rows.withColumn("_m", m).withColumn("recommended_in_results", F.max("_m").over(w))
    return out.filter(F.col("_m") | ~F.col("recommended_in_results")).drop("_m")


def semi_or_all_by_mention(rows: DataFrame, reply: str, *, query_id: str = "query_id",
                           handle: str = "handle") -> DataFrame:
    """Per query keep rows whose handle (as a phrase) occurs in the
    normalised reply text when any does, else keep all."""
    rep = phrase(F.coalesce(F.col(reply), F.lit("")))
    hp = phrase(F.lower(str_or_blank(handle)))
    m = (rep != "") & (hp != "") & (F.instr(rep, hp) > 0)
    w = Window.partitionBy(query_id)
    out = rows.withColumn("_m", F.coalesce(m, F.lit(False))).withColumn("_any", F.max("_m").over(w))
    return out.filter(F.col("_m") | ~F.col("_any")).drop("_m", "_any")


def card_text(position: Column, handle: Column, from_price: Column, storage: Column,
              conditions: Column, colors: Column, link: Column) -> Column:
    """One card block (B5) for a model row."""
    lk = F.when(str_or_blank(link) == "", F.lit(X.EMPTY_FIELD)).otherwise(str_or_blank(link))
    return X.fill(X.CARD, n=position.cast("string"), title=pretty_handle(handle), price=format_price(from_price),
                  options=compact_values(storage), conditions=compact_values(conditions),
                  colors=compact_values(colors), link=lk)


def render_cards(rows: DataFrame, *, query_id: str = "query_id", order: str = "position",
                 extra: list | None = None) -> DataFrame:
    """One text per query: numbered card blocks joined by a blank line.

    Numbers restart at 1 in ``order`` (after any J5/J6 filtering).
    ``extra`` aggregate columns are computed in the same grouping."""
    items = F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col("handle").alias("h"), F.col("from_price").alias("f"),
        F.col("storage_options").alias("s"), F.col("condition_options").alias("c"),
        F.col("color_options").alias("k"), F.col("product_link").alias("l"))))
    blocks = F.transform(items, lambda x, i: card_text(i + 1, x["h"], x["f"], x["s"], x["c"], x["k"], x["l"]))
    return rows.groupBy(query_id).agg(F.array_join(blocks, X.CARD_SEP).alias("cards"), *(extra or []))


def rank_hits(scores: DataFrame, k: int, *, query_id: str = "query_id", score: str = "score",
              keys: list[str] | None = None) -> DataFrame:
    """Rank 1..k per query by score descending, ties by key."""
    keys = keys or KEYS
    w = Window.partitionBy(query_id).orderBy(F.col(score).desc(), *[F.col(c) for c in keys])
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .withColumn("rank", F.col("rank").cast("long"))


def available_models(catalog: DataFrame, prefix: str, limit: int | None = 50) -> DataFrame:
    """Distinct handles with a case-insensitive prefix (P9), sorted,
    limited; blank handles are dropped after the limit.  Without a limit it
    is the whole set, as S4's test needs it."""
    h = F.col("handle")
    d = catalog.select(h).filter(h.isNotNull() & prefix_ilike(h, prefix)).distinct()
    return (d if limit is None else d.orderBy(h).limit(limit)).filter(h != "")


def prefix_ilike(col: Column, prefix: str) -> Column:
    """Case-insensitive prefix test (``ILIKE prefix%`` with the prefix literal)."""
    return F.startswith(F.lower(col), F.lower(F.lit(prefix)))


def top_k_after_filter(hits: DataFrame, records: DataFrame, k: int = 5, *, query_id: str = "query_id",
                       price_min=None, price_max=None) -> DataFrame:
    """Walk hits by rank, keep the first k whose record passes the price
    filter.  Unlike G7 the price is read as a plain number (no 'RM'
    stripping), so text prices never fail the test."""
    fields = [c for c in RECORD_FIELDS if c in records.columns]
    rows = hits.join(records.select(*KEYS, *fields), KEYS, "left")
    raw = F.col("price")
    p = F.when(py_number(raw), raw.try_cast("double"))
    lo = _bound(price_min)
    hi = _bound(price_max)
    keep = p.isNull() | ((lo.isNull() | (p >= lo)) & (hi.isNull() | (p < hi)))
    w = Window.partitionBy(query_id).orderBy("rank")
    return rows.filter(keep).withColumn("shown", F.row_number().over(w)).filter(F.col("shown") <= k) \
        .withColumn("shown", F.col("shown").cast("long"))


def _bound(b) -> Column:
    if b is None:
        return F.lit(None).cast("double")
    return _c(b) if isinstance(b, (str, Column)) else F.lit(float(b))


def py_number(col: Column) -> Column:
    """Text that Python's float() would accept (plain decimal / exponent)."""
    from quaymind.functions.text import _NUMBER, py_strip
    return py_strip(col.cast("string")).rlike(_NUMBER)




def no_match_message(price_min: Column | str, price_max: Column | str) -> Column:
    """S3: message for an empty result; precedence both > max > min > none."""
    lo, hi = _c(price_min), _c(price_max)
    los, his = lo.cast("string"), hi.cast("string")
    return (F.when(lo.isNotNull() & hi.isNotNull(), X.fill(X.NO_MATCH_RANGE, lo=los, hi=his))
            .when(hi.isNotNull(), X.fill(X.NO_MATCH_UNDER, hi=his))
            .when(lo.isNotNull(), X.fill(X.NO_MATCH_ABOVE, lo=los))
            .otherwise(F.lit(X.NO_MATCH_ANY)))


def constrain_model(df: DataFrame, model: str, allowed: DataFrame | None) -> DataFrame:
    """A recommended model not in the allowed handle list becomes ''.

    ``allowed`` is a DataFrame with a ``handle`` column (e.g. S1's output);
    None and an empty list both mean that nothing is constrained.  One left
    join on the distinct allowed handles; whether there are any is a flag
    of the same plan (one broadcast row), not a job of its own.
    """
    if allowed is None:
        return df
    a = allowed.select(F.col("handle").alias("_allowed")).distinct()
    # "" stands for "the list has entries": it never equals a model that is tested
    any_ = a.limit(1).select(F.lit("").alias("_blank"))
    m = F.col(model)
    out = df.join(a, m == F.col("_allowed"), "left").withColumn("_key", F.lit("")).join(
        F.broadcast(any_), F.col("_key") == F.col("_blank"), "left")
    keep = (F.coalesce(m, F.lit("")) == "") | F.col("_allowed").isNotNull() | F.col("_blank").isNull()
    return out.withColumn(model, F.when(keep, m).otherwise(F.lit(""))).drop("_allowed", "_key", "_blank")


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order`` (one aggregation with
    ``min_by``; partial aggregation keeps hot keys cheap)."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*")
