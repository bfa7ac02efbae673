"""Main text of web pages: element subtrees that recur on many pages of a host are its template."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurybox.llm.common import settle
from jurybox.llm.tokens import chunks

MIN_PAGES = 8  # different articles beside which a subtree must stand to be template
BROADCAST_BYTES = 16 << 20

# Names of elements, classes and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr").split())
UNSEEN = frozenset("script style template link meta noscript".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption br hr".split())
DROPPED = frozenset((
    "head script style noscript template iframe svg object embed canvas audio video nav header footer aside form button select "
    "textarea input label option dialog menu title").split())
MAIN = frozenset(("article", "main"))
DROPPED_NAMES = frozenset((
    "ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe share sharing social comment "
    "comments disqus replies related recommended widget toolbar copyright disclaimer pagination pager login signup").split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = frozenset((
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul").split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
               "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
SPLIT_NAMES = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "start", "end", "first", "last", "dropped", "main", "inside")

    def __init__(self, tag: str, start: int, first: int, dropped: bool, main: bool, inside: bool) -> None:
        self.tag, self.start, self.first, self.dropped, self.main, self.inside = tag, start, first, dropped, main, inside
        self.end = self.last = -1


def is_dropped(tag: str, attrs: str) -> bool:
    """Whether an element is no article text by its own name, class, id or role."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        # A paragraph or heading is judged by whole names, anything else by their words.
        if name in ("class", "id") and not DROPPED_NAMES.isdisjoint(value.split() if tag in PROSE else SPLIT_NAMES.split(value)):
            return tag != "article" or not {"comment", "comments"}.isdisjoint(SPLIT_NAMES.split(value))
        if name == "role" and value in DROPPED_ROLES:
            return True
    return False


def parse(page: str) -> tuple[list[str | None], list[str], list[Element]]:
    """Text segments (None ends a block), a plain form of all tokens, and the elements over both, as opened.

    Tags that are not closed end with their parent; a new paragraph or list item ends the one before.
    """
    texts: list[str | None] = []
    plain: list[str] = []
    elements: list[Element] = []
    stack: list[Element] = []

    def close(upto: int) -> None:
        for e in stack[upto:]:
            e.end, e.last = len(texts), len(plain)
        del stack[upto:]

    def add(text: str) -> None:
        if text:
            texts.append(entities.unescape(text))
            if short := " ".join(text.split()):
                plain.append(short)

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag not in UNSEEN:
            texts.append(" " if tag == "br" else None)
        if found["end"] or found["end2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].main and tag in ("p", "b", "i", "span", "li", "div"):
                    break  # a stray end tag doesn't close the article
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in CLOSES_SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag or tag in ("dt", "dd") and stack[i].tag in ("dt", "dd") or tag in ("td", "th") and stack[i].tag in ("td", "th"):
                    close(i)
                    break
                if stack[i].tag in CLOSES_SAME[tag]:
                    break
        attrs = found["attrs"] or found["attrs2"] or ""
        inside = bool(stack) and (stack[-1].inside or stack[-1].main)
        dropped = is_dropped(tag, attrs)
        main = not dropped and (tag in MAIN or 'role="main"' in attrs)
        if tag in VOID:
            continue
        plain.append("<" + tag)
        element = Element(tag, len(texts), len(plain) - 1, dropped, main, inside)
        elements.append(element)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            stop = end.start() if end else size
            add(page[at:stop])
            at = end.end() if end else size
            element.end, element.last = len(texts), len(plain)
        elif attrs.rstrip().endswith("/") and tag in ("svg", "path"):
            element.end, element.last = len(texts), len(plain)
        else:
            stack.append(element)
    close(0)
    mains = [e.first for e in elements if e.main]
    for e in elements:
        if e.tag == "form" and e.dropped and any(e.first < m < e.last for m in mains):
            e.dropped = False  # a form around the whole article: only its controls go
    return texts, plain, elements


def subtree_hashes(plain: list[str], elements: list[Element]) -> list[tuple[Element, int]]:
    """Hash of each subtree that could be template: neither the frame of the page nor prose of its article."""
    import xxhash

    out = []
    for e in elements:
        if e.main or e.tag in ("html", "body", "head", "title", "script", "style", "meta"):
            continue
        if e.inside and (e.tag in PROSE or e.tag in INLINE):
            continue
        out.append((e, xxhash.xxh3_64_intdigest("\x1f".join(plain[e.first:e.last])) - (1 << 63)))
    return out


def article_sign(texts: list[str | None], elements: list[Element]) -> int:
    """What pages with copies of one article share: the longest block of <article> or <main>, else all text of the page."""
    import xxhash

    blocks, now = [], []
    for e in elements:
        if e.main:
            for part in texts[e.start:e.end]:
                if part is None:
                    blocks.append("".join(now))
                    now = []
                else:
                    now.append(part)
            blocks.append("".join(now))
            now = []
    sign = max(blocks, key=len) if blocks else " ".join(t for t in texts if t)
    return xxhash.xxh3_64_intdigest(" ".join(sign.split())) - (1 << 63)


def article_text(texts: list[str | None], elements: list[Element], gone: list[Element]) -> str:
    """Blocks of the article (of the whole body, if no element is one) without the elements gone."""
    keep = bytearray(len(texts))
    mains = [e for e in elements if e.main]
    for e in mains:
        keep[e.start:e.end] = b"\x01" * (e.end - e.start)
    if not mains:
        keep = bytearray(b"\x01") * len(texts)
    for e in gone:
        keep[e.start:e.end] = bytes(e.end - e.start)
    blocks, now = [], []
    for part, kept in zip(texts, keep):
        if part is None:
            blocks.append("".join(now))
            now = []
        elif kept:
            now.append(part)
    blocks.append("".join(now))
    return " ".join(t for b in blocks if (t := " ".join(b.split())))


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, sign): subtrees and signs of the articles beside them, at most MIN_PAGES per chunk.

    That many in one chunk are enough by themselves; fewer are all there.
    """
    for batch in batches:
        for part in chunks(batch, "html"):
            signs: dict[tuple[str, int], set[int]] = {}
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                if host and page:
                    texts, plain, elements = parse(page)
                    sign = article_sign(texts, elements)
                    for _, h in subtree_hashes(plain, elements):
                        beside = signs.setdefault((host, h), set())
                        if len(beside) < MIN_PAGES:
                            beside.add(sign)
            rows = [(host, h, sign) for (host, h), beside in signs.items() for sign in beside]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                             names=["host", "hash", "sign"])


def _extract_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            out = []
            for page, templates in zip(part.column("html").to_pylist(), part.column("templates").to_pylist()):
                texts, plain, elements = parse(page or "")
                known = frozenset(templates or ())
                gone = [e for e, h in subtree_hashes(plain, elements) if h in known] if known else []
                out.append(article_text(texts, elements, gone + [e for e in elements if e.dropped]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in part.schema.names if c not in ("html", "templates")), pa.array(out, pa.string())],
                names=[*(c for c in part.schema.names if c not in ("html", "templates")), "text"])


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, hash): the subtrees that stand beside MIN_PAGES different articles of the host, or more.

    Copies of an article count once, so what recurs in them only is no template.
    """
    read = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    beside = read.mapInArrow(_hash_pages, "host string, hash bigint, sign bigint").distinct()
    often = beside.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    return settle(often.select("host", "hash"), "templates")


def _page_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, page): the subtrees of each page, its row named by a hash of its own values."""
    for batch in batches:
        for part in chunks(batch, "html"):
            hosts, hashes, names = [], [], []
            for host, name, page in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                if host and page:
                    _, plain, elements = parse(page)
                    found = {h for _, h in subtree_hashes(plain, elements)}
                    hosts += [host] * len(found)
                    names += [name] * len(found)
                    hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(names, pa.int64())],
                                             names=["host", "hash", "page"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Deleted: subtrees that recur beside different articles of the host (paragraphs and the like inside
    <article> or <main> are never template: articles may share passages), and elements that say
    themselves that they are no article text. What is left of <article> or <main> is the text, of the
    body where a page has neither. Null and empty pages give an empty text; pages without a host have
    no template. Repeated rows and copies of an article count once and give a row each, an empty table
    none; other columns are not read. A host's templates are sent to all tasks where they are few,
    else each page's own are looked up by (host, hash).
    """
    templates = host_templates(pages, url, html)
    total = templates.agg(F.sum(F.length("host") + 40)).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if total <= BROADCAST_BYTES:
        known = templates.groupBy("host").agg(F.collect_list("hash").alias("templates"))
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        rows = rows.withColumn("page", F.xxhash64("host", "html"))
        own = rows.select("host", "page", "html").mapInArrow(_page_hashes, "host string, hash bigint, page bigint").distinct()
        known = own.join(templates, ["host", "hash"]).groupBy("page").agg(F.collect_list("hash").alias("templates"))
        joined = rows.join(known, "page", "left")
    joined = joined.select("page_id", "url", "html", "templates")
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.mapInArrow(_extract_pages, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("bigint"))
