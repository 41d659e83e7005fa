"""Main text of web pages, with the site's own template taken out.

Each page is parsed into an element tree. Every subtree that may be template is
hashed, and Spark counts for each host on how many pages of differing content
it stands. A subtree is the site's template

* outside the article, when it recurs on ``MIN_PAGES`` contents of its host and
  on a share of at least ``OUTSIDE`` of them (running text: ``INSIDE``);
* inside the article, when it is a container (not running text: a sentence that
  many articles quote is theirs) and recurs on a share of at least ``INSIDE``.

Pages count once for each content, so a page that was copied a thousand times
is no template. Template subtrees are deleted, with the elements that by their
name say that they are not text (menus, footers, forms, scripts, and those
whose class, id or role names them so). What is left of the articles (of the
main element, else of the body, where there is none) is cut into blocks.

The keys of a host's templates are broadcast while there are at most
``BROADCAST_TEMPLATES``; beyond that, pages are joined with their templates.

Defined cases: a null or empty page has an empty text; a null or odd URL is a
host of its own name; repeated rows are extracted each; unclosed elements end
with their parents; page_ids are cast to long; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

MIN_PAGES, OUTSIDE, INSIDE = 5, 0.02, 0.5
BROADCAST_TEMPLATES = 1_000_000
SALTS = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed")}
_WORD = re.compile(r"[a-z0-9]+")

# fixed values: element names and the words of class, id and role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_RUNNING = frozenset("a abbr b blockquote cite code dd dt em h1 h2 h3 h4 h5 h6 i li mark p pre q small span strong sub sup td th tr u".split())
_ENDS_P = _BLOCK - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NOT_TEXT = frozenset("aside audio button canvas datalist dialog footer form head iframe input link menu meta nav noscript object option script select style svg template textarea title video".split())
_NOT_TEXT_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo recommended related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
# inside an article these say nothing unless the whole name is made of such words
_UNSURE = frozenset("ad ads banner comment comments menu notice notices recommended related respond share sharing social toolbar widget".split())
_PARTS = frozenset("area bar block box btn button buttons container content form group icon icons inner item items left link links list nav outer panel post posts right section top wrap wrapper".split())
_HEADER_WORDS = frozenset("header masthead banner".split())

_SURE = _NOT_TEXT_WORDS - _UNSURE


class Node:
    __slots__ = ("tag", "words", "unsure", "hidden", "children", "hash", "holds")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.children, self.hash, self.holds = tag, [], 0, False
        self.words, self.unsure, self.hidden = (), False, False
        if attrs:
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    for token in value.split():
                        own = _WORD.findall(token)
                        self.words += tuple(own)
                        if not _UNSURE.isdisjoint(own) and not (_NOT_TEXT_WORDS | _PARTS).issuperset(own):
                            self.unsure = True
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True

    def dropped(self, inside: bool) -> bool:
        if self.holds:  # the article is in it
            return False
        if self.hidden or self.tag in _NOT_TEXT:
            return True
        if not _NOT_TEXT_WORDS.isdisjoint(self.words) and not (inside and self.unsure and _SURE.isdisjoint(self.words)):
            return True
        return not inside and (self.tag == "header" or not _HEADER_WORDS.isdisjoint(self.words))


def parse(html: str) -> Node:
    """The page's tree; every node carries the hash of its subtree."""
    root = Node("html", "")
    stack, opened = [root], {"html": 1}

    def close():
        node = stack.pop()
        opened[node.tag] -= 1
        parts = [node.tag, *node.words]
        for c in node.children:
            parts.append(" ".join(c.split()) if isinstance(c, str) else f"<{c.hash:x}>")
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))

    def close_to(tags):
        while stack[-1].tag not in tags:
            close()
        close()

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag != "html" and opened.get(tag):
                close_to((tag,))
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P and opened.get("p"):
            close_to(("p",))
        if tag in _SIBLINGS:
            for up in reversed(stack):
                if up.tag in _SIBLINGS[tag]:
                    close_to((up.tag,))
                    break
                if up.tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu", "body", "html", "article", "div") or up.tag == "tr" and tag != "tr":
                    break
        attrs = m[3] or m[6] or ""
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = end.start() if end else len(html)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in _VOID:
            close()
        elif tag in _RAW:
            close()
            at = (html.find(">", at) + 1) or len(html)
    while stack:
        close()
    return root


def regions(root: Node) -> list[Node]:
    """The articles, else the main elements, else the whole page; marks what they lie in."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, ())]
    while todo:
        node, above = todo.pop()
        kind = "article" if node.tag == "article" else "main" if node.tag == "main" or "main" in node.words and node.tag in ("div", "section") else None
        inner = above
        if node is not root and node.tag != "body" and kind is None and node.dropped(True) and node.tag in _NOT_TEXT:
            continue
        if kind and not node.hidden and _NOT_TEXT_WORDS.isdisjoint(node.words):
            found[kind].append((node, above))
            if kind == "article":
                continue
        inner = (node, above)
        todo += [(c, inner) for c in reversed(node.children) if isinstance(c, Node)]
    kept = found["article"] or [x for x in found["main"] if not _within(x[1], found["main"])]
    for _, above in kept:
        while above and not above[0].holds:
            above[0].holds = True
            above = above[1]
    if not kept:
        for node in (root, *(c for c in root.children if isinstance(c, Node) and c.tag == "body")):
            node.holds = True
    return [n for n, _ in kept] or [root]


def _within(above, nodes) -> bool:
    """Whether one of the nodes is among a node's ancestors."""
    own = {id(n) for n, _ in nodes}
    while above:
        if id(above[0]) in own:
            return True
        above = above[1]
    return False


def _key(host: int, node: Node) -> int:
    return (node.hash * 0x9E3779B97F4A7C15 + host) & 0xFFFFFFFFFFFFFFFF


def subtrees(root: Node):
    """Yields (node, kind): 0 container outside the article, 1 running text there, 2 container inside."""
    inner = regions(root)
    whole = inner[0] is root
    inside = {id(n) for n in inner}
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        top = id(node) in inside and not whole
        if node.tag in _VOID:
            continue
        if not (node.holds or top or node is root):
            running = node.tag in _RUNNING
            if not within:
                yield node, 1 if running else 0
            elif not running and not node.dropped(True):
                yield node, 2
            if running or node.dropped(within):
                continue
        todo += [(c, within or top) for c in node.children if isinstance(c, Node)]


def blocks(root: Node, template) -> list[str]:
    """The article's blocks; ``template`` tells whether a node's subtree is to be deleted."""
    inner = regions(root)
    whole = inner[0] is root
    out, now = [], []

    def flush():
        if now and (text := " ".join("".join(now).split())):
            out.append(text)
        now.clear()

    for top in inner:
        todo: list = [top]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                now.append(node)
            elif node is not top and (node.dropped(not whole) or template(node)):
                if node.tag in _BLOCK:
                    flush()
            elif node.tag == "br":
                now.append(" ")
            elif node.tag in _BLOCK:
                flush()
                todo.append(None)
                todo += reversed(node.children)
            else:
                todo += reversed(node.children)
        flush()
    return out


def host_of(url: str | None) -> int:
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = url or ""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 1)


def _count(batches):
    """Rows (host, key, content, kind) of pages (page_id, url, html); kind -1 stands for the page itself."""
    for batch in batches:
        rows = ([], [], [], [])
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2)):
            html = html.as_py()
            if not html:
                continue
            root, host = parse(html), host_of(url)
            inner = regions(root)
            content = xxhash.xxh64_intdigest(b"".join(n.hash.to_bytes(8, "little") for n in inner))
            seen = {_key(host, n): kind for n, kind in subtrees(root)}
            seen[host] = -1
            rows[0].extend([host] * len(seen))
            rows[1].extend(seen)
            rows[2].extend([content] * len(seen))
            rows[3].extend(seen.values())
        yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.uint64).view(np.int64)) for c in rows[:3]), pa.array(rows[3], pa.int32())], ["host", "key", "content", "kind"])


def templates(pages: DataFrame) -> DataFrame:
    """(key): the template subtrees of all hosts, each by its host and hash."""
    rows = pages.mapInArrow(_count, "host long, key long, content long, kind int")
    counted = rows.groupBy("host", "key", "content").agg(F.max("kind").alias("kind")).groupBy("host", "key").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    counted = stage(counted.where((F.col("n") >= MIN_PAGES) | (F.col("kind") == -1)), "subtrees")
    of_host = counted.where("kind = -1").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("kind") == 0, OUTSIDE).otherwise(INSIDE)
    found = counted.where("kind >= 0").join(of_host, "host").where(F.col("n") >= share * F.col("pages"))
    return stage(found.select("key").distinct(), "templates")


def _extract(known):
    """Rows (page_id, url, text, n_deleted). ``known``: a broadcast sorted array of keys, else None for a fourth column of them."""

    def run(batches):
        for batch in batches:
            keys = None if known is None else known.value
            out = ([], [])
            own = batch.column(3).to_pylist() if known is None else None
            for i, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                deleted = 0
                host = host_of(url)
                mine = frozenset(own[i] or ()) if own else None

                def template(node):
                    nonlocal deleted
                    key = _key(host, node)
                    if mine is not None:
                        hit = (key - (1 << 64) if key >> 63 else key) in mine
                    else:
                        k = int(np.searchsorted(keys, np.uint64(key)))
                        hit = k < len(keys) and int(keys[k]) == key
                    deleted += hit
                    return hit

                html = html.as_py()
                root = parse(html) if html else None
                if root is not None and (mine or mine is None and len(keys)):
                    allowed = {id(n) for n, _ in subtrees(root)}
                    found = blocks(root, lambda n: id(n) in allowed and template(n))
                else:
                    found = blocks(root, lambda n: False) if root is not None else []
                out[0].append("\n".join(found))
                out[1].append(deleted)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], ["page_id", "url", "text", "n_deleted"])

    return run


def main_text(pages: DataFrame, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(page_id, url, text, n_deleted) of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = templates(pages)
    out = "page_id long, url string, text string, n_deleted int"
    if found.count() <= broadcast_templates:
        keys = np.sort(found.toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
        return pages.mapInArrow(_extract(spark.sparkContext.broadcast(keys)), out)
    # a page is known by its id, address and content; a template that a host has everywhere is dealt to SALTS tasks
    this = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.xxhash64("url", "html"), F.xxhash64("html", "url", F.lit(1)))
    rows = pages.withColumn("page", this).select("page", "url", "html").mapInArrow(_page_keys, "page string, key long").withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)))
    salted = found.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    mine = rows.join(salted, ["key", "salt"]).groupBy("page").agg(F.collect_set("key").alias("keys"))
    joined = pages.withColumn("page", this).join(mine, "page", "left").select("page_id", "url", "html", "keys")
    return joined.mapInArrow(_extract(None), out)


def _page_keys(batches):
    """Rows (page, key) of pages (page, url, html): the keys of each page's subtrees, each once."""
    for batch in batches:
        pages, keys = [], []
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            if html:
                host = host_of(url)
                own = {_key(host, n) for n, _ in subtrees(parse(html))}
                pages.extend([page] * len(own))
                keys.extend(own)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.string()), pa.array(np.array(keys, np.uint64).view(np.int64))], ["page", "key"])
