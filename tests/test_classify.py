"""Classifiers against plain-Python statements of the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from quaymind.operators import classify as C

TERMS = ["middle east", "nation_1", "nation_10", "asia", "east", "kl", "kl sentral", "st. john"]


def py_detect(text, terms):
    msg = text.lower()
    for t in sorted(terms, key=len, reverse=True):
        if re.search(r"\b" + re.escape(t) + r"\b", msg):
            return t
    return None


def test_detect_location_edges(spark):
    texts = ["Shop near NATION_10 please", "nation_1, nation_10", "middle  east", "Middle East!", "kl sentral",
             "the east side", "visit st. johnny", "st. john", "asia_x asia", "éasia", "kl-sentral", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.detect_location_expr("t", sorted(TERMS, key=lambda x: -len(x)))).collect()]
    ranked = [t for t in sorted(TERMS, key=len, reverse=True)]
    assert got == [py_detect(t, ranked) for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["nation_1", "nation_10", "middle", "east", "asia", "kl", "sentral",
                                          " ", "  ", ",", "_", "é", "x", "st.", "john"]), max_size=8)
                .map("".join), min_size=1, max_size=10))
def test_detect_location_property(spark, texts):
    ranked = sorted(TERMS, key=len, reverse=True)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.detect_location_expr("t", ranked)).collect()]
    assert got == [py_detect(t, ranked) for t in texts]


def test_escalation_greetings(spark):
    texts = ["hi", "hi there", "hi!", " hi", "Hello team", "I already logged a ticket", "talk to a human",
             "open a ticket pls", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = C.detect_escalation("t", ["hi", "hello"], ["already logged a ticket"], ["human", "talk to"], ["ticket"])
    got = [(r[0]["escalate"], r[0]["response"]) for r in df.select(e).collect()]
    g = C.GREETING_REPLY
    assert got == [(True, g), (True, g), (False, ""), (False, ""), (True, g), (True, "TICKET_LOGGED"),
                   (True, "log_ticket"), (True, "log_ticket"), (False, "")]


def test_faq_and_refinement(spark):
    texts = ["has elle", "trade-in value", "how long for delivery", "rm", "show me a warm phone", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    faq = [r[0] for r in df.select(C.is_faq_query("t", ["sell", "tradein"], ["how", "long", "delivery"])).collect()]
    assert faq == [True, True, True, False, False, False]
    ref = [r[0] for r in df.select(C.is_refinement("t", ["rm", "under"])).collect()]
    # 'warm' contains 'rm'; 'a' has no 2+ char token
    assert ref == [True, True, True, True, True, False]


def test_table_and_expression_find_the_same_location(spark):
    from quaymind.operators import classify as CL
    texts = ["Shop near NATION_10 please", "nation_1, nation_10", "middle  east", "Middle East!", "x", "", None, "go to st. ives now",
             "Middle East!", "st.ives", "(c) here", "a(c)b", "\\E odd"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id bigint, t string")
    terms = ["middle east", "nation_1", "nation_10", "east", "asia", "st. ives", "(c)", "\\e odd"]
    d = spark.createDataFrame([(t, i + 1) for i, t in enumerate(terms)], "term string, ordinal bigint")
    ranked = CL._ranked_terms(d)
    order = lambda rows: sorted(rows, key=repr)
    one = order((r["id"], r["t"], r["loc"]) for r in df.select("id", "t", CL.detect_location_expr("t", ranked).alias("loc")).collect())
    two = order((r["id"], r["t"], r["loc"]) for r in CL.detect_location(df, "t", d, out="loc").collect())
    assert one == two
    assert ("Middle East!" in [t for _, t, _ in two]) and [loc for _, t, loc in two if t == "Middle East!"] == ["middle east"] * 2


def test_large_dictionaries_behave_like_small_ones(spark):
    from quaymind.operators import classify as CL
    for n in (4999, 5001):
        d = spark.createDataFrame([(f"place{i}", i) for i in range(n)], "term string, ordinal bigint")
        df = spark.createDataFrame([("place7",), ("place7",), ("where is the shop in place8",)], "t string")
        found = CL.detect_location(df, "t", d, out="loc")
        routed = found.withColumn("asks", CL.is_location_query("t", ["kiosk"], [], F.col("loc"))).collect()
        assert sorted((r["loc"], r["asks"]) for r in routed) == [("place7", True), ("place7", True), ("place8", True)]
        ranked = CL._ranked_terms(d)
        assert len(ranked) == n
    with pytest.raises(ValueError):
        CL.location_term("t", None)
