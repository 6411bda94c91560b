"""Running folds, merges and cuts over long arrays and texts, held against plain Python."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from quaymind.llm import html_text, pii, secrets
from quaymind.llm.spans import merged, pieces_between, scan, without_overlaps, without_starts

SPAN = "array<struct<s:int,e:int>>"


def spans_of(draw, n, room):
    out = []
    for _ in range(n):
        s = draw.randrange(room)
        out.append((s, s + 1 + draw.randrange(6)))
    return out


def test_scan_is_a_running_sum_and_maximum(spark):
    draw = random.Random(5)
    rows = [([draw.randrange(50) for _ in range(n)],) for n in (0, 1, 127, 128, 129, 256, 257, 40_000)]
    got = spark.createDataFrame(rows, "v array<int>").select(
        "v", scan(F.col("v"), F.lit(0), lambda a, x: a + x).alias("total"), scan(F.col("v"), F.lit(0), F.greatest).alias("top"))
    for r in got.collect():
        assert r.total == list(accumulate(r.v)) and r.top == list(accumulate(r.v, max))


def test_merges_match_all_pairs(spark):
    draw = random.Random(8)
    rows = [(spans_of(draw, n, 6 * n + 1), spans_of(draw, m, 6 * n + 1)) for n, m in
            [(0, 0), (0, 3), (3, 0), *[(draw.randrange(1, 60), draw.randrange(1, 60)) for _ in range(60)]]]
    got = spark.createDataFrame(rows, f"a {SPAN}, b {SPAN}").select(
        "a", "b", without_overlaps(F.col("a"), F.col("b")).alias("free"), merged(F.col("a")).alias("stretches")).collect()
    for r in got:
        free = [x for x in r.a if not any(y.s < x.e and x.s < y.e for y in r.b)]
        assert sorted(r.free) == sorted(free)
        want = []
        for s, e in sorted(r.a):
            if want and s <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], e))
            else:
                want.append((s, e))
        assert [tuple(x) for x in r.stretches] == want


def test_spans_with_a_taken_start_go(spark):
    row = spark.createDataFrame([([(1, 2), (4, 9), (7, 8)], [(0, 3), (4, 5), (8, 9)])], f"a {SPAN}, b {SPAN}").select(
        without_starts(F.col("a"), F.col("b")).alias("kept")).first()
    assert [tuple(x) for x in row.kept] == [(1, 2), (7, 8)]


@pytest.mark.parametrize("chars", ["ab\n", "ä😀x"])
def test_pieces_around_stretches_over_many_blocks(spark, chars):
    text = chars * 3_000
    cuts = [(0, 2), (1_023, 1_024), (1_024, 1_030), (2_048, 5_000), (8_999, 9_000)]
    row = spark.createDataFrame([(text, cuts)], f"t string, c {SPAN}").select(
        pieces_between(F.col("t"), F.col("c")).alias("p")).first()
    ends = [0, *[e for _, e in cuts]]
    assert row.p == [text[a:b] for a, b in zip(ends, [*[s for s, _ in cuts], len(text)])]


def test_every_match_of_a_long_text_is_placed_and_redacted(spark):
    n = 20_000
    text = " ".join(f"password=abcdef{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    assert secrets.redact_documents(docs).first().text == " ".join(["[SECRET]"] * n)
    mails = " ".join(f"mail u{i}@host.com now" for i in range(n))
    row = pii.mentions(spark.createDataFrame([(1, mails)], "doc_id long, text string")).select(
        "n_email", F.transform("seeds", lambda x: x["s"]).alias("starts"), F.size("candidates").alias("loose")).first()
    assert row.n_email == n and row.loose == 0
    assert row.starts == [m + 5 for m in range(len(mails)) if mails.startswith("mail ", m)]


def test_words_that_the_context_cuts_make_no_pattern(spark):
    long = ["x" * 60 + tail for tail in ("first", "second")]
    docs = [(i, f"{w} id a{i}@b.com then") for i, w in enumerate(long)]
    docs += [(2, "the id a2@b.com"), (3, 'note id: ("a3@b.com") then')]
    rows = pii.mentions(spark.createDataFrame(docs, "doc_id long, text string")).select(
        "doc_id", F.element_at("seeds", 1)["patterns"].alias("p")).collect()
    patterns = {r.doc_id: r.p for r in rows}
    assert len(patterns[0]) == 1 and patterns[0] == patterns[1]        # "id _ then"; the long word is in no pattern
    assert len(patterns[2]) == 1                                       # "the id _", up to the text's start
    assert len(patterns[3]) == 2 and patterns[0][0] in patterns[3]     # brackets, quotes and colons part words


def test_link_shares_are_summed_once(monkeypatch):
    page = html_text.Page("<body><div class=w>" + "".join(
        f"<div class=e><p>text {i} <a href=x>link</a></p></div>" for i in range(3_000)) + "</div></body>")
    nodes = [x for x in page.nodes if x.path]
    for node in nodes[:50]:
        chars = links = 0
        for i, (text, at) in enumerate(page.blocks):
            while at is not None and at is not node:
                at = at.parent
            if at is node:
                chars, links = chars + len(text), links + page.link_chars[i]
        assert page.link_share(node) == (links / chars if chars else 1.0)
    monkeypatch.setattr(page, "blocks", None)       # no later share reads a block
    assert all(page.link_share(x) <= 1.0 for x in nodes)
