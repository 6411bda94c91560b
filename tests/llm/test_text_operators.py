"""Tokens, pages, near-duplicates, quality, preferences and top-k against plain versions."""

import random

import pytest
from helpers import WORD, classes, documents, sha

from quaymind.llm import bpe, html_text, preferences, quality, simhash, topk
from quaymind.llm.common import project


# ---------------------------------------------------------------- byte-level BPE

@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers as P
    import tiktoken
    ranks = bpe.read_ranks(bpe.vocabulary())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    out = ["", "   ", " a", "a  b", "a   b \n c\t d  ", "x" * 3000, "é" * 700, "日本語テキスト" * 90, "😀 😀  😀", "don't we'll 's",
           "\x85 a\x1c b", "　 a　b", None]
    out += ["".join(rng.choice("ab \n\t　é1.'s") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return out


def test_tokens_match_tiktoken(spark, reference_encoder):
    texts = odd_texts()
    got = {r.doc_id: r for r in bpe.op7_bpe(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = reference_encoder.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text or ""))


def test_round_trip(spark):
    texts = [t for t in odd_texts()]
    rows = project(documents(spark, texts), {"doc_id": "bigint", "text": "string"})
    back = bpe.detokenize(bpe.tokenize(rows))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_many_trees_and_single_trees_agree(reference_encoder):
    import public_tokenizers as P
    codec = bpe.Codec(reference_encoder._mergeable_ranks, P.PATTERN)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("theanodr ingsé") for _ in range(rng.randint(2, 60))).encode()[:64] for _ in range(300)]
    for size in (64, 128):
        assert codec._encode_short(pieces, size) == [codec._encode_long(p) for p in pieces]


# ---------------------------------------------------------------- pages

PAGE = """<html><body><div id="cookie-banner">We use cookies</div><header><h1>Site</h1></header>
<div class="menu m2"><a href="/">Home</a></div><div class="content c{n}"><article><h1>Title &amp; {n}</h1>
<p>First   paragraph,&nbsp;with a <a href="x">link</a>.<p>Second<br>line {n}<ul><li>one<li>two</ul>
<div class="ad">BUY</div><form><input>q</form></article><section class="comments"><p>A comment, long, long, long.</p></section>
</div><aside>side</aside><footer>&copy; foot</footer><script>var t = "</p>";</script></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, HOST string")


def test_article_text(spark):
    rows = [(f"https://h{n % 2}.example.com/{n}", PAGE.replace("{n}", str(n))) for n in range(6)]
    rows += [(None, None), ("not a url", ""), ("https://x.example.com", "just text"), ("http://y.example.com", "<p>a<p>b &lt;")]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.op3_html(pages(spark, rows)).collect()}
    for n in range(6):
        assert got[n][1] == f"Title & {n}\nFirst paragraph, with a link.\nSecond line {n}\none\ntwo"
        assert got[n][2] == len(got[n][1])
    assert [got[i][1] for i in (6, 7, 8, 9)] == ["", "", "just text", "a\nb <"]


def test_host_consensus_beats_a_page_of_its_own(spark):
    # on most pages of the host the text stands in div.post; on one of them a longer box stands beside it
    usual = "<body><div class='post'><p>{t}</p></div><div class='box'><p>note</p></div></body>"
    odd = "<body><div class='post'><p>short text, really.</p></div><div class='box'><p>" + "long words, " * 40 + "</p></div></body>"
    rows = [("http://a.example.com/", usual.replace("{t}", f"text number {i}, with words.")) for i in range(5)]
    rows.append(("http://a.example.com/odd", odd))
    got = {r.page_id: r.text for r in html_text.op3_html(pages(spark, rows)).collect()}
    assert got[5] == "short text, really."
    assert got[0] == "text number 0, with words."


ENTRY = "<p>" + "The body of it, in many words. " * 8 + "</p>"
LAST = "<blockquote><p>" + "A longer quotation, of some length. " * 20 + "</p></blockquote>"


@pytest.mark.parametrize("page", [
    "<article><h1>Title {n}</h1><p>lead</p><div class=entry>{entry}</div></article>",
    "<div class=post><h1>Title {n}</h1><p>lead</p><div class=entry>{entry}</div></div>",
    "<article><section class=intro><h1>Title {n}</h1><p>lead</p></section><section class=body>{entry}</section></article>",
    "<div class=page><section class=intro><h1>Title {n}</h1><p>lead</p></section><section class=body>{entry}</section></div>",
    "<main><h1>Title {n}</h1><div class=lead>lead</div><table><tr><td>{entry}</td></tr></table></main>",
])
def test_the_whole_article_is_read(spark, page):
    for entry in (ENTRY, ENTRY + LAST):
        body = "<body><div class=menu>Home</div>" + page + "<div class=box><p>note</p></div><footer>end</footer></body>"
        rows = [(f"http://a.example.com/{n}", body.replace("{n}", str(n)).replace("{entry}", entry)) for n in range(4)]
        plain = "\n".join(" ".join(x.split()) for x in entry.replace("<blockquote>", "").replace("</blockquote>", "")
                          .replace("<p>", "").split("</p>") if x)
        got = {r.page_id: r.text for r in html_text.op3_html(pages(spark, rows)).collect()}
        assert got == {n: f"Title {n}\nlead\n{plain}" for n in range(4)}


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "nav-open", "layout-with-header", "post comments-closed",
                                  "entry related-work", "sidebar-left", "hasSidebar"])
@pytest.mark.parametrize("inner", ["article", "div", "main"])
def test_layout_names_hide_no_article(name, inner):
    page = (f"<body><div class=menu>Home and more</div><div class='{name}'><{inner}><h1>Title</h1><p>First words, and more of them.</p>"
            f"<div class='comments'>A comment.</div><div class=ad-box>BUY</div></{inner}></div><div class=cookie-banner>Cookies</div></body>")
    assert html_text.Page(page).extract([]) == "Title\nFirst words, and more of them."


@pytest.mark.parametrize("header", ["div class=article-header", "header class=entry-header", "header class=header"])
def test_headings_of_an_article_header_stay(header):
    page = f"<article><{header}><h1>Title</h1><p>by me</p></{header.split()[0]}><p>First words, and more of them.</p></article>"
    assert html_text.Page(page).extract([]) == "Title\nFirst words, and more of them."


@pytest.mark.parametrize("name", ["comments", "sidebar", "related-posts", "site-header", "menu-container", "widget"])
def test_furniture_beside_an_article_stays_hidden(name):
    page = (f"<body><div class=post><p>First words, and more of them, in some number.</p></div>"
            f"<div class='{name}'><p>short.</p></div></body>")
    assert html_text.Page(page).extract([]) == "First words, and more of them, in some number."


def test_long_comments_stay_hidden():
    page = "<article><p>First words.</p></article><div class=comment-list><article>" + "A comment, long. " * 30 + "</article></div>"
    assert html_text.Page(page).extract([]) == "First words."


@pytest.mark.parametrize("source", ["<div>" * 3000 + "x", "<" * 3000, "<a " * 2000, "<!-- open", "<p title='x > y'>x", "</p></div>x"])
def test_broken_pages_do_not_fail(source):
    assert html_text.Page(source).extract([]) is not None


# ---------------------------------------------------------------- near-duplicates

def fingerprint(text):
    import xxhash
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "  \t", "One", "one", "a b", "É x", "é x"]
    for _ in range(12):
        own = [rng.choice(words) for _ in range(220)]
        for k in range(5):
            copy = list(own)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("node_rows", [20_000, 10])
def test_components_match_all_pairs(spark, node_rows):
    texts = near_texts()
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    roots = classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts), node_rows=node_rows).collect()}
    assert {i: r.component_id for i, r in got.items()} == roots
    assert {i: r.fp % 2**64 for i, r in got.items()} == prints
    assert len(set(roots.values())) < len(texts) - 10


@pytest.mark.parametrize("shingles", [1 << 15, (1 << 15) + 1, 70_000, 200_000])
def test_long_texts_are_hashed_whole(shingles):
    for seed in range(3):
        rng = random.Random(seed)
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(shingles + 2))
        assert simhash.fingerprint(text) == fingerprint(text)


def test_no_shingle_is_lost_between_pieces(monkeypatch):
    # a piece of 4: five shingles make a second piece of one
    monkeypatch.setattr(simhash, "PIECE", 4)
    for n in range(1, 40):
        text = " ".join(f"w{k}" for k in range(n))
        assert simhash.fingerprint(text) == fingerprint(text)


def test_one_document_of_every_class_stays(spark):
    texts = near_texts() + ["same row"] * 3 + ["null id"] * 2
    ids = list(range(len(texts) - 5)) + [900] * 3 + [None] * 2
    kept = simhash.one_per_class(documents(spark, texts, ids=ids)).collect()
    prints = [fingerprint(t) for t in texts]
    roots = classes(list(range(len(texts))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((ids[i] is None, ids[i] or 0) for i in set(roots.values()))


def test_classes_with_one_id_or_none_stay_apart(spark):
    own = [" ".join(f"c{c}w{k}" for k in range(400)) for c in range(4)]
    other = ["changed " + t.split(" ", 1)[1] for t in own]
    pairs = [(a, b) for a, b in zip(own, other) if 0 < (fingerprint(a) ^ fingerprint(b)).bit_count() <= 2]
    assert pairs                                          # a class of two fingerprints
    texts = own[:2] + list(pairs[0])
    kept = simhash.one_per_class(documents(spark, texts, ids=[7, 7, 7, 7])).collect()
    assert len(kept) == len({own.index(t) if t in own else other.index(t) for t in texts})
    kept = simhash.one_per_class(documents(spark, list(pairs[0]), ids=[None, None])).collect()
    assert len(kept) == 1


def test_walk_finds_all_near_pairs():
    import numpy as np
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(5 << 40), base ^ np.uint64(7)])
    a = np.unique(near)
    want = {(i, j) for i in range(len(a)) for j in range(len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    got = {(int(x), int(y)) for i, j in simhash.walk(a, a, 0, 0, 2) for x, y in zip(i, j)}
    assert got == want


# ---------------------------------------------------------------- quality rules

def repeated(words):
    from collections import Counter
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)})


def test_measures_match_plain_counting(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "# a|b <c> $5", "x\nx\n y \n\nx"] + [
        "\n".join(" ".join(rng.choice("a b c d é".split()) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30)))
        for _ in range(60)]
    got = {r.doc_id: r for r in quality.op6_quality(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated(words))
        assert got[i].base_failed == (len(words) < 10 or 100 * repeated(words) > 20 * len(words))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = [" ".join(f"u{i}x{k}" for k in range(30)) for i in range(40)]
    furniture = "Home | About 2024 | all the usual links of this site in one long line with more of them behind it"
    texts = [f"{furniture}\n{t}" if i < 30 else t for i, t in enumerate(own)] + [f"{furniture}\nfew words{i}" for i in range(3)]
    texts += ["one popular document " + " ".join(f"p{k}" for k in range(30))] * 50
    df = documents(spark, texts, ["host"] * len(texts))
    kept = {r.doc_id for r in quality.op6_quality(df).collect() if r.kept}
    assert kept == set(range(40)) | set(range(43, 93))
    clean = {r.doc_id: r for r in quality.clean_documents(df).collect()}
    assert set(clean) == kept
    assert clean[0].text == own[0] and clean[0].n_chars == len(own[0]) and clean[35].text == own[35]


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_lines_go_however_large_the_host(spark, monkeypatch, broadcast_bytes):
    if broadcast_bytes is not None:
        monkeypatch.setattr(quality, "BROADCAST_BYTES", broadcast_bytes)
    own = [" ".join(f"v{i}x{k}" for k in range(20)) for i in range(200)]
    notice, rare = "Subscribe to our list for more news like this every week", "a line that ten texts of the host hold"
    # 30 of 200 distinct texts (15 %) and exact copies; ten texts hold the rare line, in any number of copies
    texts = [f"{notice}\n{t}" if i < 30 else f"{t}\n{rare}" if i < 40 else t for i, t in enumerate(own)]
    texts += [texts[0]] * 25 + [texts[35]] * 25
    texts += [f"{notice}\nnot more than{i} these words" for i in range(2)] + [None]
    for hosts in (["h"] * len(texts), [None] * len(texts)):
        df = documents(spark, texts, hosts)
        clean = {r.doc_id: r for r in quality.clean_documents(df).collect()}
        kept = {r.doc_id for r in quality.op6_quality(df).collect() if r.kept}
        assert set(clean) == kept == set(range(250))
        for i in [*range(200), *range(200, 225)]:
            want = own[i if i < 200 else 0]
            assert clean[i].text == (f"{want}\n{rare}" if 30 <= i < 40 else want) and clean[i].n_chars == len(clean[i].text)


def test_lines_are_removed_from_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    changed = [r for r in quality.clean_documents(docs).collect() if r.text != before[r.doc_id]]
    assert changed and all(len(r.text) < len(before[r.doc_id]) and r.n_chars == len(r.text) for r in changed)


# ---------------------------------------------------------------- preference pairs

def test_prompt_is_rendered_once_and_masks_cover_replies(spark):
    turn = lambda r, t: {"role": r, "text": t}
    chosen = [turn("user", "hi"), turn("assistant", "hello"), turn("user", "more"), turn("assistant", "yes é")]
    rejected = chosen[:2] + [turn("user", "more"), turn("assistant", "no")]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, chosen, rejected), (2, chosen, chosen), (3, None, rejected), (4, [], [])], schema)
    got = {r.pair_id: r for r in preferences.format_pairs(df).collect()}
    assert got[1].n_prompt_turns == 3 and got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nyes é<|end|>\n"
    assert [got[1].chosen[m.start:m.end] for m in got[1].chosen_mask] == ["yes é<|end|>"]
    assert [got[1].rejected[m.start:m.end] for m in got[1].rejected_mask] == ["no<|end|>"]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (4, "", "")
    assert got[3].n_prompt_turns == 0 and got[3].chosen == "" and len(got[3].rejected_mask) == 2
    assert got[4].prompt == ""


# ---------------------------------------------------------------- exact top-k

def plain_topk(rows, k=5, every=50):
    import math
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, w) in enumerate(valid):
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(w, v)), i) for n, (i, v) in enumerate(valid) if n != own)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_matches_all_pairs(spark, scale):
    rng = random.Random(9)
    rows = [(i, [scale * rng.choice([-1, -0.5, 0.25, 1.0]) * (1 + i % 3) for _ in range(4)]) for i in range(600)]
    rows += [(1000 + i, [scale, scale, 0.0, 0.0]) for i in range(300)]          # one vector many times
    rows += [(5000, None), (5050, [1.0, None, 0.0, 0.0]), (5100, [float("nan")] * 4), (5150, [float("inf")] * 4),
             (None, [scale] * 4), (5200, [1.0]), (5250, []), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, SCORE int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, pivots=5).collect())
    padded = [(i, v if v is None else v + [0.0] * (4 - len(v))) for i, v in rows]
    assert got == plain_topk(padded)


def test_topk_over_several_query_slices(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, query_every=20, slice_bytes=600).collect())
    assert got == plain_topk(rows, every=20)


def test_topk_keeps_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    # repeats of a candidate and of a query, and an id with two vectors
    rows += [rows[7]] * 6 + [rows[50]] * 2 + [(100, [9.0, -9.0, 9.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, pivots=3).collect())
    assert got == plain_topk(rows)
    assert any(q == v for q, _, v, _ in got)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
