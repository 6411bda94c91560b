"""V4: the recommendation flow as one function over tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymind.operators import recommend as R
from quaymind.operators.vectors import vector_topk

#: Optional columns of a query table and what stands for a missing one.
OPTIONS = {"price_min": "double", "price_max": "double", "preferred": "array<string>", "model": "string", "reply": "string"}


def recommend(queries: DataFrame, corpus: DataFrame, catalog: DataFrame, *, stopwords: list[str], models: int = 3,
              candidates: int = 50, query_id: str = "query_id", query_vec: str = "embedding", domain: str = "",
              reply: Column | None = None) -> DataFrame:
    """One answer per query: V3 -> G7 -> J5 -> J6 -> B5, or S3's message.

    ``queries`` has an id and a vector and may have price_min, price_max,
    preferred (handles shown before), model (the recommended one) and reply
    (the intro text, e.g. from U1); ``reply`` gives the last as an expression.
    Returns query_id, answer (the cards, or the no-match message), n_models,
    recommended_in_results (false where nothing was found) and found.

    Every query keeps its row: one without a vector, without hits or without
    a hit inside its price bounds gets the message.
    """
    asked = queries.select(F.col(query_id), F.col(query_vec).alias("_vec"), *[
        (F.col(c) if c in queries.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONS.items()])
    if reply is not None:
        asked = asked.withColumn("reply", reply)
    hits = vector_topk(asked.where(F.col("_vec").isNotNull()), corpus, candidates, query_id=query_id, query_vec="_vec")
    bounds = asked.select(query_id, "price_min", "price_max", "preferred")
    grouped = R.diverse_models(hits.join(bounds, query_id), catalog, models, query_id=query_id, price_min="price_min",
                               price_max="price_max", preferred="preferred", domain=domain)
    rows = grouped.join(asked.select(query_id, "model", "reply"), query_id)
    rows = R.semi_or_all_by_model(rows, "model", stopwords, query_id=query_id)
    rows = R.semi_or_all_by_mention(rows, "reply", query_id=query_id)
    cards = R.render_cards(rows, query_id=query_id, extra=[
        F.max("recommended_in_results").alias("_in"), F.count(F.lit(1)).alias("_n")])
    out = asked.select(query_id, "price_min", "price_max").join(cards, query_id, "left")
    return out.select(query_id, F.coalesce("cards", R.no_match_message("price_min", "price_max")).alias("answer"),
                      F.coalesce("_n", F.lit(0)).cast("long").alias("n_models"),
                      F.coalesce("_in", F.lit(False)).alias("recommended_in_results"), F.col("cards").isNotNull().alias("found"))
