"""HTML extraction: site templates found by counting hashed element subtrees per host, then the article's text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, table

#: A subtree of little text is a template if at least this share of a host's pages, and at least so many, have it. Pages whose
#: undropped texts differ in digits at most count once, so mirrored articles don't make their own text a template.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 5
#: A subtree of so many characters, which don't recur by chance, is one on so many pages, or on this share of a smaller host's.
LONG_CHARS, MANY_PAGES, LOW_SHARE = 24, 50, 0.05
#: Template subtrees that may be broadcast (a few bytes each); with more, pages and templates are joined by host.
BROADCAST_ROWS = 100_000

#: Share of a page's undropped text that an article or main element must have to be taken for the article, and share of a
#: container's text that one article in it must have to be taken alone (others beside it are teasers).
LEAST_SHARE, MAIN_SHARE = 0.25, 0.6
#: An element whose class names say that it is not the article is one after all if it has at least this share of the page's
#: text outside links, unless they say that readers wrote it.
CONTENT_SHARE = 0.6

# Element and class names, from HTML and from common usage.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg object select canvas audio video".split())
_DROPPED = frozenset("nav footer aside form head button dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CLOSES_P = _BLOCKS - set("option optgroup caption tbody thead tfoot tr td th body html head".split())
#: What a start tag of an element ends, unless one of the elements of _BARRIER is open inside it.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {t: ("p",) for t in _CLOSES_P - {"li", "dt", "dd"}}
_BARRIER = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_P_BARRIER = ("td", "th", "article", "div", "section", "body", "button")
_TABLE = frozenset("table caption tbody thead tfoot tr td th".split())

#: Parts of class names that say what an element is; a name says so if all its parts do or are among _NEUTRAL, as in "site-nav",
#: but not in "ad-hoc". Readers' comments have their own.
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_CLASSES = _COMMENTS | frozenset("ad ads adbox advert adverts advertisement advertising adsense adsbygoogle adslot banner sponsor sponsored promo promotion promoted side sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended toolbar pagination pager login masthead topbar".split())
_NEUTRAL = frozenset("left right top bottom main site page global primary secondary header head bar box block wrap wrapper container inner outer area section module widget item items list links link buttons button icons group unit slot zone text form message posts stories articles media mobile desktop sticky fixed small large first last google js".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+(?:x\d+)?")

# A tag ends at the next > outside a quoted attribute value, or with the page. Every alternative matches up to there, so each
# character is read once, but for a quote that never ends, which is then a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^=>]+|=\s*(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z)""", re.S)
_DIGITS = re.compile(r"\d+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none")


@dataclass(slots=True)
class Node:
    """A block element, or an inline one that is dropped: its parts are texts and nodes in page order.

    `verdict` is "drop" for what is never article text, "class" or "comments" for what only class names call so, else "".
    `size` and `linked` are the characters of its texts, and of those inside links.
    """

    tag: str
    verdict: str = ""
    inline: bool = False
    parts: list = field(default_factory=list)
    hash: int = 0
    size: int = 0
    linked: int = 0
    holds_article: bool = False


def _named(value: str) -> str:
    """What the names of a class or id attribute call an element: "class", "comments" or nothing."""
    found = ""
    for name in value.split():
        parts = [x.lower() for x in _PART.findall(name)]
        if set(parts) & _CLASSES and all(x in _CLASSES or x in _NEUTRAL or x[0].isdigit() for x in parts) and "".join(parts) == "".join(c for c in name.lower() if c.isalnum()):
            found = "comments" if set(parts) & _COMMENTS else found or "class"
    return found


def _verdict(tag: str, attributes: str, inside_article: bool) -> str:
    if tag in _DROPPED or (tag == "header" and not inside_article):
        return "drop"
    if not attributes or attributes.isspace() or tag in ("html", "body", "main"):
        return ""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return "drop"
    if found.get("role", "").lower() in _ROLES:
        return "drop"
    named = {_named(html.unescape(found.get(k, ""))) for k in ("class", "id")}
    return "comments" if "comments" in named else "class" if "class" in named and tag != "article" else ""


def parse(source: str) -> Node:
    """The tree of block elements and dropped inline ones. Other inline tags leave no trace; unclosed p, li, cells and the like end
    where HTML ends them. The cost is in proportion to the page: open elements are found by name, not by a search."""
    root = Node("")
    stack = [root]
    opened: dict[str, list[int]] = {}
    at, links = 0, 0
    find = _TOKEN.search

    def last(tags: tuple[str, ...] | frozenset[str]) -> int:
        return max([opened[t][-1] for t in tags if opened.get(t)], default=0)

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag].pop()
            _seal(node)
            stack[-1].size += node.size
            stack[-1].linked += node.linked
            stack[-1].holds_article |= node.holds_article or node.tag in ("article", "main")

    def add(text: str) -> None:
        top = stack[-1]
        top.parts.append(text)
        n = len(text.strip())
        top.size += n
        if links:
            top.linked += n

    def start(node: Node) -> None:
        stack[-1].parts.append(node)
        opened.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    while m := find(source, at):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        end, tag, attributes = m.groups()
        if tag:
            tag = tag.lower()
            if tag in _RAW:
                if not attributes.endswith("/"):
                    over = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = over.end() if over else len(source)
                stack[-1].parts.append(" ")
            elif tag == "br":
                stack[-1].parts.append(" ")
            elif tag in _BLOCKS:
                ends = last(_ENDS.get(tag, ()))
                if tag in ("li", "dt", "dd") and last(("p",)) > ends:
                    ends = ends or last(("p",))
                if ends and ends > last(_P_BARRIER if _ENDS[tag] == ("p",) else _BARRIER[tag]):
                    close(ends)
                node = Node(tag, _verdict(tag, attributes, bool(opened.get("article") or opened.get("main"))))
                if tag in _VOID:
                    stack[-1].parts.append(node)
                else:
                    start(node)
            elif tag not in _VOID and not attributes.endswith("/"):
                links += tag == "a"
                verdict = "drop" if tag in _DROPPED else _verdict(tag, attributes, True) if attributes else ""
                if verdict or opened.get(tag):
                    start(Node(tag, verdict, True))
        elif end:
            end = end.lower()
            if end == "a" and links:
                links -= 1
            if opened.get(end) and (end in _TABLE or opened[end][-1] > last(("td", "th", "caption"))):
                close(opened[end][-1])
    if at < len(source):
        add(source[at:])
    close(1)
    _seal(root)
    return root


def _seal(node: Node) -> None:
    """Give a finished node the hash of its subtree: of its tag, white-space-folded texts and the parts' hashes."""
    node.hash = xxhash.xxh3_64_intdigest("\x01".join([node.tag, *[f"\x02{p.hash}" if isinstance(p, Node) else " ".join(p.split()) for p in node.parts]])) >> 1


def _judge(root: Node) -> None:
    """Settle the verdicts that rest on class names: what holds the article, or most of the page's text, is not beside it."""
    free, todo = 0, [root]
    while todo:
        node = todo.pop()
        if node.verdict != "drop":
            free += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
            todo.extend(p for p in node.parts if isinstance(p, Node))
    todo = [root]
    while todo:
        node = todo.pop()
        if node.verdict == "class" and (node.holds_article or (node.size - node.linked) >= CONTENT_SHARE * max(free, 1)):
            node.verdict = ""
        elif node.verdict:
            node.verdict = "drop"
        if not node.verdict:
            todo.extend(p for p in node.parts if isinstance(p, Node))


def subtrees(root: Node) -> tuple[dict[int, bool], int]:
    """Hashes of all subtrees below the body, with whether they have LONG_CHARS, and the hash of all texts that no rule drops, without digits."""
    _judge(root)
    found, kept = {}, []
    todo = [(root, False)]
    while todo:
        node, gone = todo.pop()
        gone = gone or bool(node.verdict)
        for p in node.parts:
            if isinstance(p, Node):
                todo.append((p, gone))
            elif not gone:
                kept.append(p)
        if node.tag not in ("", "html", "body", "hr") and not node.inline:
            found[node.hash] = node.size >= LONG_CHARS
    return found, xxhash.xxh3_64_intdigest(_DIGITS.sub("", "\x01".join(" ".join(t) for p in kept if (t := p.split())))) >> 1


def _kept(root: Node, templates: frozenset[int] | set[int]) -> Iterator[str | tuple[str, Node]]:
    """Texts outside dropped elements and template subtrees in page order, and ("start" or "end", block) around blocks."""
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, (str, tuple)):
            yield item
        elif not item.verdict and item.hash not in templates:
            if not item.inline:
                yield ("start", item)
                todo.append(("end", item))
            todo.extend(reversed(item.parts))


def _container(root: Node, templates: frozenset[int] | set[int]) -> Node:
    """The element that holds the article: the article or main element with most kept text, a dominant article inside a main
    element, or the whole page where these have little of its text."""
    sizes: dict[int, int] = {}
    nodes: dict[int, tuple[Node, list[int]]] = {}
    stack: list[int] = []
    total = 0
    for item in _kept(root, templates):
        if isinstance(item, str):
            n = len(item.strip())
            total += n
            for key in stack:
                sizes[key] += n
        elif item[1].tag in ("article", "main"):
            key = id(item[1])
            if item[0] == "start":
                nodes[key], sizes[key] = (item[1], list(stack[:1])), 0
                if len(stack) < 2:  # an article in an article is part of it
                    stack.append(key)
            elif stack and stack[-1] == key:
                stack.pop()
    best = max((k for k in nodes if not nodes[k][1]), key=sizes.get, default=None)
    if best is None or sizes[best] < LEAST_SHARE * total:
        return root
    if nodes[best][0].tag == "main":
        inner = max((k for k in nodes if nodes[k][1] == [best]), key=sizes.get, default=None)
        if inner is not None and sizes[inner] >= MAIN_SHARE * sizes[best]:
            return nodes[inner][0]
    elif sizes[best] < MAIN_SHARE * sum(sizes[k] for k in nodes if not nodes[k][1]):
        return Node("", parts=[nodes[k][0] for k in nodes if not nodes[k][1]])  # none stands out: all of them
    return nodes[best][0]


def article(root: Node, templates: frozenset[int] | set[int]) -> str:
    """Text of the article's blocks, one a line, without dropped elements and template subtrees."""
    _judge(root)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    for item in _kept(_container(root, templates), templates):
        if isinstance(item, str):
            run.append(item)
        else:
            flush()
    flush()
    return "\n".join(out)


def host(url: Column) -> Column:
    """Lower-cased host of a URL without user, port or a leading www; null if there is none."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(name != "", name)


def templates(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(host, hash) of the subtrees that recur across a host's pages, from a frame (host, html) of pages with a host.

    Pages count once for each distinct text outside dropped elements. Subtrees are made distinct in each task before they are shuffled and
    counted with partial aggregates, so a host with a third of the pages gathers counts, not pages, in a task.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows: set[tuple[str, int, int, bool]] = set()
                for name, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found, content = subtrees(parse(source))
                    rows.update((name, content, h, long) for h, long in found.items())
                    rows.add((name, content, -1, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["host", "content", "hash", "long"])

    each = mapped(pages, go, "host string, content bigint, hash bigint, long boolean").distinct()
    counts = table(each.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("long").alias("long")).where(F.col("n") >= least), "subtrees")
    totals = counts.where("hash = -1").select("host", F.col("n").alias("pages"))
    enough = F.when(F.col("long"), F.least(F.lit(float(MANY_PAGES)), LOW_SHARE * F.col("pages"))).otherwise(share * F.col("pages"))
    return counts.where("hash <> -1").join(totals, "host").where(F.col("n") >= F.least(enough, share * F.col("pages"))).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per page: (page_id, url, text, n_chars).

    `text` has the article's blocks in page order, one a line: without elements that are never article text (by tag or role, or
    by class names where they don't hold the article or most of the page's text) and without subtrees recurring across many
    pages of the page's host. Character references are decoded, white space
    in a block is one space. Null or empty html gives an empty text; a page without a host has no templates; repeated rows and
    null ids pass through. Template subtrees of a host are at most pages / MANY_PAGES or 1 / LOW_SHARE times a page's subtrees;
    all lists are broadcast if they are `broadcast_rows` rows at most, and joined by host otherwise.
    """
    spark = pages.sparkSession
    key = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("host", host(F.col("url")))
    found = table(templates(base.where("host IS NOT NULL AND html <> ''").select("host", "html"), share, least), "templates")
    schema = f"page_id {key}, url string, text string, n_chars bigint"
    if len(rows := found.limit(broadcast_rows + 1).collect()) <= broadcast_rows:
        lists: dict[str, set[int]] = {}
        for r in rows:
            lists.setdefault(r.host, set()).add(r.hash)
        shared = spark.sparkContext.broadcast(lists)
        return mapped(base, _pages(lambda batch: (shared.value.get(h, ()) for h in batch.column(3).to_pylist())), schema)
    lists = table(found.groupBy("host").agg(F.collect_list("hash").alias("gone")), "template-lists")
    return mapped(base.join(lists, "host", "left").select("page_id", "url", "html", "gone"), _pages(lambda batch: (set(x or ()) for x in batch.column(3).to_pylist())), schema)


def _pages(gone):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                text = [article(parse(source), t) for source, t in zip(part.column(2).to_pylist(), gone(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return go
