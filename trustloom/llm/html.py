"""Operator 4: main text of web pages, with site templates removed.

Each page is parsed into elements. Subtrees with text, inside articles and outside, are
hashed (tags, classes and text) and counted per host by Spark, once per distinct main
part; subtrees that recur in at least `MIN_PAGES` of them and in `MIN_SHARE` of the
host's are template and are deleted. Pieces of a sentence and single cells or rows of a
table are never deleted alone. Elements that are boilerplate by their tag, role or class
are deleted too. The main text is what is left of the article or main elements, or of the
body if none.

Null, empty and malformed html give what can be read, else the empty text. Pages with the
same main part count as one, so that a copied article stays. A null url, or one that is no
URL, is a host of its own name ''. Whole pages of any length and depth are read; repeated
rows give repeated results, empty tables empty ones. Other columns stay; those called text
or n_chars, in any case, are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.common import cut, replace_columns, schema_with, table

MIN_PAGES, MIN_SHARE = 5, 0.3
HOST, KNOWN = "\x01host", "\x01known"  # names that no table has
MAX_TEMPLATES = 200_000  # most template hashes that are broadcast; beyond, they are joined

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_RAW = ("script", "style", "textarea", "noscript", "template", "svg", "iframe")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW + ("title",)}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: never deleted alone as templates
_KEPT = frozenset("html body td th tr thead tbody tfoot dt dd caption".split())
_DROP = frozenset("nav header footer aside form button select dialog menu head".split()) | set(_RAW)
#: names, each a whole word of class, id or role, of what is never text of a page
_NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense ad-slot ad-box ad-banner banner-ad banner cookie cookies cookie-banner cookie-notice cookie-bar cookie-consent
consent consent-banner notice notices site-notice sidebar side-bar sidebar-left sidebar-right menu main-menu nav navbar nav-bar navigation main-nav site-nav topnav footer site-footer page-footer header
site-header masthead promo promos promotion promotions related related-posts related-articles related-links related-stories share sharing share-buttons share-bar social social-links social-share
social-media breadcrumb breadcrumbs newsletter newsletter-signup subscribe subscription popup pop-up modal overlay sponsor sponsors sponsored widget widgets pagination pager login signup search search-box
contentinfo complementary search-form""".split())
#: names of what readers wrote
_READERS = re.compile(r"^(?:user-|reader-)?(?:comments?|replies|reply|responses?|disqus\w*|discussion)(?:-(?:list|thread|section|area|form|box|item|body|text|\d+))?$|^respond$")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "inside")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.inside = tag, name, []


def parse(page: str) -> Node:
    root = Node("#")
    stack, at = [root], 0

    def text(piece):
        if piece:
            stack[-1].inside.append(entities.unescape(piece))

    while m := _TOKEN.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closed = {"p"} if tag in _BLOCK and tag != "br" and tag != "p" else _CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closed:
                del stack[k:]
                if tag != "tr":
                    break
            elif stack[k].tag in _BLOCK:
                break
        name = " ".join(v.strip("\"'") for _, v in _ATTRIBUTE.findall(m.group(3))) if "=" in m.group(3) else ""
        node = Node(tag, name)
        stack[-1].inside.append(node)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not m.group(3).endswith("/"):
            stack.append(node)
    text(page[at:])
    return root


def walk(root: Node):
    """Nodes, each before what it holds; no recursion, so depth is no matter."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.inside) if isinstance(x, Node)]


def by_readers(node: Node) -> bool:
    return bool(node.name) and any(_READERS.match(w) for w in node.name.lower().split())


def boilerplate(node: Node) -> bool:
    if node.tag in _DROP:
        return True
    if not node.name or node.tag in ("html", "body"):
        return False
    if by_readers(node):
        return True
    # an article or a heading is text whatever its name, and so is an element that its site names in a longer word
    return node.tag not in ("article", "main") and node.tag not in _HEADINGS and any(w in _NAMES for w in node.name.lower().split())


def tops_of(root: Node) -> list[Node]:
    """The outermost article and main elements, those that readers wrote apart, or the root if there are none."""
    nodes = [n for n in walk(root) if n.tag in ("article", "main") and not by_readers(n)]
    inner = {id(x) for n in nodes for x in walk(n) if x is not n}
    return [n for n in nodes if id(n) not in inner] or [root]


def digests(root: Node) -> tuple[dict[int, int], set[int]]:
    """(id of node -> hash of its subtree, ids of nodes whose subtree has text)."""
    out, told = {}, set()
    for node in reversed(list(walk(root))):
        parts = []
        for x in node.inside:
            piece = str(out[id(x)]) if isinstance(x, Node) else _SPACE.sub(" ", x).strip()
            if id(x) in told if isinstance(x, Node) else piece:
                told.add(id(node))
            parts.append(piece if isinstance(x, Node) else "t" + piece)
        out[id(node)] = xxhash.xxh64_intdigest("\x01".join([node.tag, node.name, *parts]), 7) - (1 << 63)
    return out, told


def hashes(root: Node, known: tuple[dict[int, int], set[int]] | None = None) -> dict[int, int]:
    """id of node -> hash of its subtree, for subtrees with text that can be deleted alone."""
    of, told = known or digests(root)
    out = {}
    for node in walk(root):
        inline = [x for x in node.inside if not (isinstance(x, Node) and x.tag in _BLOCK) and (isinstance(x, Node) or x.strip())]
        for x in node.inside:
            # an inline element beside text or other inline elements is a piece of a sentence
            if isinstance(x, Node) and id(x) in told and x.tag not in _KEPT and (x.tag in _BLOCK or len(inline) == 1):
                out[id(x)] = of[id(x)]
    return out


def main_text(page: str | None, template) -> str:
    root = parse(page or "")
    of = hashes(root) if template else {}
    gone = {i for i, h in of.items() if h in template}
    tops = tops_of(root)
    blocks, now = [], []

    def end():
        block = _SPACE.sub(" ", "".join(now)).strip()
        if block:
            blocks.append(block)
        now.clear()

    todo = list(reversed(tops))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif x is None:
            end()
        elif not (boilerplate(x) and x not in tops) and id(x) not in gone and x.tag != "title":
            apart = x.tag in _BLOCK or x.tag == "#"
            if apart:
                end()
                todo.append(None)
            todo += reversed(x.inside)
    end()
    return "\n".join(blocks)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash): subtrees that recur across the host's pages. A page's own row has hash null."""

    def run(batches):
        for batch in batches:
            seen = set()
            for url, page in zip(*(c.to_pylist() for c in batch.columns)):
                h, root = host(url), parse(page or "")
                known = digests(root)
                whole = xxhash.xxh64_intdigest(",".join(str(known[0][id(n)]) for n in tops_of(root)), 7) - (1 << 63)
                seen.add((h, None, whole))
                seen.update((h, x, whole) for x in hashes(root, known).values())
            columns = list(zip(*seen)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["host", "hash", "whole"])

    rows = pages.select("url", "html").mapInArrow(run, "host string, hash long, whole long").distinct()
    counted = rows.groupBy("host", "hash").agg(F.count("*").alias("n"))
    counted = cut(counted.filter((F.col("n") >= MIN_PAGES)))
    whole = counted.filter("hash is null").select("host", F.col("n").alias("pages"))
    return counted.filter("hash is not null").join(whole, "host").filter(F.col("n") >= F.col("pages") * MIN_SHARE).select("host", "hash")


def extract(pages: DataFrame) -> DataFrame:
    """Add text and n_chars to pages."""
    found = cut(templates(pages))
    many = found.count() > MAX_TEMPLATES
    known: dict[str, set] = {}
    for r in [] if many else found.collect():  # at most MAX_TEMPLATES
        known.setdefault(r.host, set()).add(r.hash)
    sent = pages.sparkSession.sparkContext.broadcast(known)
    if many:  # at most 1 / MIN_SHARE * (elements of a page) hashes per host on average

        def named(batches):
            for batch in batches:
                hosts = [host(u) for u in batch.column(batch.schema.get_field_index("url")).to_pylist()]
                yield replace_columns(batch, {HOST: pa.array(hosts, pa.string())})

        pages = pages.mapInArrow(named, schema_with(pages, f"`{HOST}` string")).join(found.groupBy(F.col("host").alias(HOST)).agg(F.collect_set("hash").alias(KNOWN)), HOST, "left")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            urls, html_ = batch.column(at("url")).to_pylist(), batch.column(at("html")).to_pylist()
            own = [set(k or ()) for k in batch.column(at(KNOWN)).to_pylist()] if many else [sent.value.get(host(u), ()) for u in urls]
            texts = [main_text(p, k) for p, k in zip(html_, own)]
            yield replace_columns(batch, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.mapInArrow(run, schema_with(pages, "text string, n_chars long")).drop(HOST, KNOWN)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
