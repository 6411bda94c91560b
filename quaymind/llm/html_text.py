"""Main text of web pages by consensus host paths.

1. Each page is parsed once; its containers get a score from the text that
   their blocks hold outside page furniture, less what links hold.  A
   container's path is generalised: tag and class names from the root down,
   with digits as ``#`` and ids left out.
2. Spark adds up the scores per host and path; the best paths of a host are
   its consensus.  Votes are summed map-side, so a host with a third of all
   pages is only a frequent key of a sum.
3. Each page is parsed again and the containers on the host's best path that
   the page has are looked up; a page that has none of them falls back on its
   own best container.  What they are parts of gives the text: the nearest
   article or main around them, or without one the element with text of its
   own, or with several sections, around them.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments) is known by tag, role and the first or last word of
a class or id, and is left out at any depth; headings inside an article's
header stay.  Names of layout or state (has-sidebar, nav-open) hide nothing,
and no name hides what holds the page's main or most of its text.

Blocks are joined in page order by one newline; white space inside a block
becomes one space; character references are decoded.

Defined cases: null or empty html gives an empty text; a page without
containers is read from its body; a null url votes in a host of its own;
broken nesting closes at the next matching tag; an empty table gives no rows;
repeated rows are separate pages; ties between paths go to the smaller path;
very long pages are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymind.llm.common import BROADCAST_BYTES, bound_arrow_batches, materialize, project
from quaymind.session import ship_package

#: Paths kept per host, best first.
PATHS_PER_HOST = 3
#: A container with more than this share of its text in links is furniture.
MAX_LINK_SHARE = 0.5
SALTS = 32

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+")

# Fixed by HTML: elements without an end tag, with raw text, and those that a paragraph ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td
    tfoot th thead tr ul caption""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: What an element of this kind closes when it opens, up to the nearest scope element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main aside nav header footer form".split())

FURNITURE_TAGS = frozenset("""nav aside footer form script style noscript template iframe button select textarea svg head
    title menu dialog object canvas audio video map datalist label input""".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
FURNITURE_WORDS = frozenset("""nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead sidebar aside
    widget ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent
    gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus reply replies
    respond share sharing social related recommended pagination pager toolbar topbar skip""".split())
#: Words that make a class or id one of layout or state: what the element is with, not what it is.
LAYOUT_WORDS = frozenset("has no not with without".split())
STATE_WORDS = frozenset("open opened closed collapsed enabled disabled".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
HEADER_WORDS = frozenset("header masthead".split())
#: What an article's own header may be named after.
ARTICLE_WORDS = frozenset("article entry post story content".split())


class Node:
    __slots__ = ("tag", "path", "hidden", "links", "blocks", "parent", "score", "order")

    def __init__(self, tag, path, hidden, parent, order):
        self.tag, self.path, self.hidden, self.parent, self.order = tag, path, hidden, parent, order
        self.score = 0.0


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]))
    return out


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes of an element, generalised."""
    if "class" not in attributes:
        return tag
    names = sorted({re.sub(r"[0-9]+", "#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *names])


def _short(path: str) -> str:
    """A long path by its hash, so that deep nesting stays linear."""
    return path if len(path) <= 512 else "#" + hashlib.md5(path.encode()).hexdigest()


def _is_furniture(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or state say furniture."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return attributes.get("role", "").lower() in FURNITURE_ROLES


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The words of every class and id."""
    said = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [w for x in said.split() if (w := _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))]


def _own_header(name: list[str]) -> bool:
    return len(name) > 1 and name[0] in ARTICLE_WORDS and name[-1] in HEADER_WORDS


def _says_furniture(name: list[str]) -> bool:
    """A class or id says furniture by its first or last word, unless it is one of layout or state."""
    if not LAYOUT_WORDS.isdisjoint(name) or name[-1] in STATE_WORDS or _own_header(name):
        return False
    return name[0] in FURNITURE_WORDS or name[-1] in FURNITURE_WORDS


class Page:
    """Blocks and containers of one page, in page order.

    A block is (text, node): the nearest container above it.
    """

    def __init__(self, source: str):
        self._read_all(source, frozenset())
        spared = self._spared()
        if spared:
            self._read_all(source, spared)

    def _read_all(self, source: str, spared: frozenset[int]) -> None:
        self.blocks: list[tuple[str, Node]] = []
        self.link_chars: dict[int, int] = {}
        self._sums: tuple[list[int], list[int]] | None = None
        root = Node("html", "", False, None, 0)
        self.nodes = [root]
        # open elements: tag, container, hidden, in a link, in an article, in a header, hidden by more than the header,
        # hidden by more than a name, number if a name hides it
        self._stack: list[tuple] = [("html", root, False, False, False, False, False, False, None)]
        # of elements that a name hides: whether it is a plain word, and unlinked characters, articles and mains on
        # opening, then within; the same of the page so far
        self._named: list[list] = []
        self._seen = [0, 0, 0]
        self._spare = spared
        self._text: list[str] = []
        self._linked = 0
        self._read(source)
        self._cut(1)

    def _cut(self, at: int) -> None:
        """Close the open elements from this one on."""
        for x in self._stack[at:]:
            if x[8] is not None:
                named = self._named[x[8]]
                named[1:] = [now - then for now, then in zip(self._seen, named[1:])]
        del self._stack[at:]

    def _spared(self) -> frozenset[int]:
        """Elements that a name hides but that hold the page's main, or most of its unlinked text: with all
        articles in it, or when the name is no plain furniture word and not of comments."""
        return frozenset(i for i, (plain, chars, articles, mains) in enumerate(self._named)
                         if mains or (2 * chars > self._seen[0] and (0 < articles == self._seen[1] or not plain)))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, self._stack[-1][1]))
                self.link_chars[len(self.blocks) - 1] = min(len(text), self._linked)
            self._text, self._linked = [], 0

    def _add(self, raw: str) -> None:
        top = self._stack[-1]
        if not raw:
            return
        link = top[3]
        if not (link or top[7]):
            self._seen[0] += len(raw.strip())
        if top[2]:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if link:
            self._linked += len(text.strip())

    def _close(self, names) -> None:
        """Close the nearest open element of these names, unless a scope element is in between."""
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at][0] in names:
                self._flush()
                self._cut(at)
                return
            if self._stack[at][0] in SCOPE:
                return

    def _open(self, tag: str, raw: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                if tag == "hr":
                    self._flush()
                else:
                    self._add(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag])
        _, above, hidden, link, in_article, in_header, furniture, sure, _ = self._stack[-1]
        attributes: dict[str, str] = {}
        if raw and raw != "/":
            if "=" in raw:
                attributes = _attributes(raw)
            if "hidden" in raw and "hidden" in raw.lower().split():
                attributes["hidden"] = ""
        sure = sure or _is_furniture(tag, attributes, in_article)
        header, named = tag == "header", None
        if not sure:
            self._seen[1] += tag == "article"
            self._seen[2] += tag == "main"
            if attributes and tag not in ("html", "body", "main", "article"):
                names = _names(attributes)
                header = header or (in_article and any(map(_own_header, names)))
                bad = [x for x in names if _says_furniture(x) and not (header and HEADER_WORDS.issuperset(x))]
                if bad:
                    named = len(self._named)
                    self._named.append([any(len(x) == 1 or not COMMENT_WORDS.isdisjoint(x) for x in bad), *self._seen])
        furniture = furniture or sure or (named is not None and named not in self._spare)
        # inside an article's header only the headings count
        if tag in HEADINGS and in_header and in_article:
            hidden = furniture
        else:
            hidden = hidden or furniture or header
        node = above
        if tag in CONTAINERS and not hidden:
            node = Node(tag, f"{_short(above.path)}>{_step(tag, attributes)}", hidden, above, len(self.nodes))
            self.nodes.append(node)
        self._stack.append((tag, node, hidden, link or tag == "a", in_article or tag == "article" or tag == "main",
                            in_header or header, furniture, sure, named))

    def _read(self, source: str) -> None:
        at, n, text_from = 0, len(source), 0
        while at < n:
            at = source.find("<", at)
            if at < 0:
                break
            m = _TAG.match(source, at)
            if m is None:          # a lone "<" is text
                at += 1
                continue
            self._add(source[text_from:at])
            at = text_from = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if m[1]:
                if tag == "br":
                    self._add(" ")
                    continue
                open_at = len(self._stack) - 1
                while open_at and self._stack[open_at][0] != tag:
                    open_at -= 1
                if open_at:
                    if tag in BLOCKS or any(s[0] in BLOCKS for s in self._stack[open_at:]):
                        if tag not in BLOCKS:
                            # an inline end tag does not close blocks that opened inside
                            continue
                        self._flush()
                    self._cut(open_at)
                elif tag in BLOCKS:
                    self._flush()
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = text_from = end.end() if end else n
                continue
            self._open(tag, m[3] or "")
        self._add(source[text_from:])
        self._flush()

    # ------------------------------------------------------------ scores and texts

    def scored(self) -> list[Node]:
        """The containers with a score: a block counts for its container, half for the one above, and so on."""
        for i, (text, node) in enumerate(self.blocks):
            linked = self.link_chars[i]
            value, share = len(text) - 2.0 * linked + 10.0 * min(text.count(",") + text.count("."), 20), 1.0
            while node is not None and share > 0.05:
                node.score += value * share
                node, share = node.parent, share / 2.0
        return [x for x in self.nodes if x.score > 0.0 and x.path]

    def text_under(self, chosen: list[Node]) -> str:
        wanted = {x.order for x in chosen}
        inside: dict[int, bool] = {}
        for node in self.nodes:            # parents come first
            inside[node.order] = node.order in wanted or (node.parent is not None and inside[node.parent.order])
        return "\n".join(text for text, node in self.blocks if inside[node.order])

    def link_share(self, chosen: Node) -> float:
        """The share of a container's text that stands in links; all sums are made once, from the leaves up."""
        if self._sums is None:
            chars, links = [0] * len(self.nodes), [0] * len(self.nodes)
            for i, (text, node) in enumerate(self.blocks):
                chars[node.order] += len(text)
                links[node.order] += self.link_chars[i]
            for node in reversed(self.nodes):      # parents come first
                if node.parent is not None:
                    chars[node.parent.order] += chars[node.order]
                    links[node.parent.order] += links[node.order]
            self._sums = chars, links
        chars, links = (x[chosen.order] for x in self._sums)
        return links / chars if chars else 1.0

    def best(self) -> Node | None:
        return min(self.scored(), key=lambda x: (-x.score, x.order), default=None)

    def whole(self, chosen: list[Node]) -> list[Node]:
        """What the chosen containers are parts of: the article (or main) around each, or else the
        element that has text of its own beside it, or of whose sections it is one."""
        own: dict[int, bool] = {}
        sections: dict[int, int] = {}
        for i, (text, node) in enumerate(self.blocks):
            own[node.order] = own.get(node.order, False) or len(text) > self.link_chars[i]
        for x in self.nodes:
            if x.tag == "section" and x.parent is not None:
                sections[x.parent.order] = sections.get(x.parent.order, 0) + 1
        out = {}
        for node in chosen:
            top = node
            while top is not None and top.tag not in ("article", "main"):
                top = top.parent
            if top is None:
                top = node
                while (above := top.parent) is not None and above.tag in ("section", "div", "blockquote") and (
                        top.tag == "blockquote" or own.get(above.order)
                        or (top.tag == "section" and sections.get(above.order, 0) > 1)):
                    top = above
                if top is not node and self.link_share(top) > MAX_LINK_SHARE:
                    top = node
            out[top.order] = top
        return list(out.values())

    def extract(self, paths: list[str]) -> str:
        """The text of what the containers on the first of the paths that gives any are parts of, or the page's
        own best container."""
        for path in paths:
            found = [x for x in self.nodes if x.path == path and self.link_share(x) <= MAX_LINK_SHARE]
            if found and self.text_under(found):
                return self.text_under(self.whole(found))
        own = self.best()
        return self.text_under(self.whole([own])) if own else "\n".join(text for text, _ in self.blocks)


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            best: dict[str, float] = {}
            for node in Page(source or "").scored():
                best[node.path] = best.get(node.path, 0.0) + node.score
            total = sum(best.values())
            # a page has one vote, shared by its containers' scores; in millionths, so that sums are exact
            for path, score in best.items():
                hosts.append(host)
                paths.append(path)
                scores.append(round(1e6 * score / total))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                                          pa.array(scores, pa.int64())], names=["host", "path", "score"])


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source or "").extract(paths or []) for source, paths in
                 zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """host and its consensus paths, best first."""
    votes = (pages.select("host", "html").mapInArrow(_vote_batches, "host string, path string, score long")
             .groupBy("host", "path").agg(F.sum("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("score").desc(), "path"))
    return (votes.withColumn("rank", rank).where(F.col("rank") <= paths_per_host)
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("p"))
            .select("host", F.transform("p", lambda x: x["path"]).alias("paths")))


def extract_text(pages: DataFrame, paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """page_id, url and text of every page."""
    ship_package(pages.sparkSession)
    bound_arrow_batches(pages.sparkSession)
    rows = project(pages, {"page_id": "bigint", "url": "string", "html": "string"}).withColumn("host", host_of(F.col("url")))
    chosen = materialize(host_paths(rows, paths_per_host), "host-paths")
    size = chosen.agg(F.coalesce(F.sum(F.octet_length(F.array_join("paths", "")) + F.octet_length("host") + 64),
                                 F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(chosen), "host", "left")
    else:
        salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            salted, ["host", "salt"], "left")
    return met.select("page_id", "url", "html", "paths").mapInArrow(
        _extract_batches, "page_id long, url string, text string")


def op3_html(pages: DataFrame) -> DataFrame:
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
