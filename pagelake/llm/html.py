"""Main text of web pages by composite text density.

A small tree builder reads the whole page; every node gets characters per tag, adjusted for link text; a node's
density sum is that of its children's densities; the subtree with the largest sum is the core of the article. It
grows to the <article> (else <main>) it is in, and further while it has siblings of text: those as dense as the
thinnest block on the way from the densest node up to the body, and a headline where it has none of its own.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these closes an open paragraph.
OTHER_BLOCK = BLOCK - {"p"}
ENDS_P = BLOCK - frozenset("html body option optgroup button caption tbody td tfoot th thead tr legend frameset iframe".split())
#: An opening tag closes an open element of the set, searched up to one of SCOPE.
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
}
SCOPE = frozenset("ul ol dl table select html body article section main div".split())
#: Never part of an article, whatever their density.
DROPPED = frozenset("script style noscript template head title nav aside footer form button select textarea input iframe object embed svg canvas dialog menu noembed noframes".split())
#: What a mark takes from an element's weight: it stays out, unless its density sum is more than so many times that of the rest.
LOWERED = 8.0
#: Words in class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "sidebars footer footers cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments disqus respond reply replies related "
    "recommended share sharing social search pagination pager toolbar masthead complementary contentinfo dialog alert".split()
)
HEADER_MARKS = frozenset("header masthead banner".split())
#: These keep their content even if a class word says otherwise.
KEPT = frozenset("html body main article".split())

TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>?)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


class Node:
    __slots__ = ("all", "attrs", "chars", "density", "headed", "kids", "link_chars", "link_tags", "name", "sum", "tags", "up")

    def __init__(self, name: str, attrs: str, up: Node | None):
        self.name, self.attrs, self.up = name, attrs, up
        self.all = self.kids = []

    def marks(self) -> set[str]:
        found: set[str] = set()
        if self.attrs:
            for m in ATTRIBUTE.finditer(self.attrs):
                key = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role"):
                    found |= set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", entities.unescape(value)).lower()))
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    found.add("\0hidden")
        return found


def parse(page: str) -> Node:
    """The tree of a page. Never fails: unknown markup is skipped, open elements end with the page."""
    root = Node("html", "", None)
    at, i = root, 0
    find, end = TAG.search, len(page)
    opened: Counter[str] = Counter()  # so that a closing tag without an open one costs nothing

    def leave(n: Node) -> Node:
        """Close n and all that is open inside it."""
        nonlocal at
        while at is not n:
            opened[at.name] -= 1
            at = at.up
        opened[n.name] -= 1
        return n.up

    def inside(names: set[str]) -> bool:
        return any(opened[x] for x in names)

    while i < end:
        m = find(page, i)
        if m is None:
            at.kids.append(page[i:])
            break
        if m.start() > i:
            at.kids.append(page[i : m.start()])
        i = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name == "p" and not opened["p"]:
                at.kids.append(Node("p", "", at))
            elif opened[name]:
                at = leave(_open(at, {name}))
            continue
        if name == "html" or (name == "body" and opened["body"]):
            continue
        if name == "body":
            opened.clear()
            at = root
        elif at.name == "head" and name not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            opened.clear()
            at = root
        for ends, names, stop in ((name in ENDS_P, {"p"}, OTHER_BLOCK), (name in SIBLINGS, SIBLINGS.get(name, set()), SCOPE), (name == "a", {"a"}, BLOCK)):
            while ends and inside(names) and (n := _open(at, names, stop)) is not None:
                at = leave(n)
        node = Node(name, m[4] or "", at)
        at.kids.append(node)
        if name in VOID or (m[4] or "").endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, i)
            if close is None:  # unclosed: the rest of the page is its content
                i = end
            else:
                node.kids.append(page[i : close.start()])
                i = close.end()
            continue
        opened[name] += 1
        at = node
    return root


def _open(at: Node | None, names: set[str], stop: frozenset[str] | set[str] = frozenset()) -> Node | None:
    while at is not None and at.name not in names:
        if at.name in stop:
            return None
        at = at.up
    return at


def _never(n: Node) -> bool:
    """Whether an element is no part of an article: by its kind, or as it isn't shown."""
    if n.name == "header":  # of the page, not of an article
        return _open(n.up, {"article", "main"}) is None
    return n.name in DROPPED or (n.name not in KEPT and bool(n.attrs) and "\0hidden" in n.marks())


def _marked(n: Node) -> bool:
    """Whether a word in class, id or role says that an element is furniture."""
    if n.name in KEPT or not n.attrs:
        return False
    marks = n.marks()
    return bool(marks & MARKS) or (bool(marks & HEADER_MARKS) and _open(n.up, {"article", "main"}) is None)


def _furniture(n: Node) -> bool:
    return _never(n) or _marked(n)


def _weigh(root: Node, kept: Set[Node] = frozenset(), marked: list[Node] | None = None) -> list[Node]:
    """chars, tags, link_chars and link_tags of each node, without furniture; the nodes, parents first. marked: gets what is left out for a mark alone; what is in `kept` isn't."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        n.kids = []
        for k in n.all:
            if isinstance(k, str) or k in kept or not _furniture(k):
                n.kids.append(k)
            elif marked is not None and not _never(k):
                marked.append(k)
        order.append(n)
        stack += [k for k in reversed(n.kids) if not isinstance(k, str)]
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.headed = n.name == "h1"
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(k.split()) and len(k.strip())
            else:
                n.chars += k.chars
                n.headed |= k.headed
                n.tags += k.tags + (k.name in BLOCK or k.name == "a")  # bold, breaks and the like count as text
                n.link_chars += k.chars if k.name == "a" else k.link_chars
                n.link_tags += k.tags + 1 if k.name == "a" else k.link_tags
    return order


def _densities(order: list[Node], body: Node) -> None:
    ratio = body.link_chars / max(body.chars, 1)
    for n in order:
        tags, links, free = max(n.tags, 1), max(n.link_chars, 1), max(n.chars - n.link_chars, 1)
        base = n.chars / free * n.link_chars + ratio * n.chars + math.e
        spread = max(n.chars / links * tags / max(n.link_tags, 1), 1.0)
        n.density = n.chars / tags * math.log(spread + math.e - 1) / max(math.log(base), 1.0) if n.chars and n.name in BLOCK else 0.0
    for n in reversed(order):  # through inline elements, down to the nearest blocks
        n.sum = sum(k.density if k.name in BLOCK else k.sum for k in n.kids if not isinstance(k, str))


def _weighed(body: Node) -> list[Node]:
    """The nodes, weighed; a marked element is among them if it outweighs all the rest in spite of its mark."""
    kept: set[Node] = set()
    while True:
        marked: list[Node] = []
        order = _weigh(body, kept, marked)
        _densities(order, body)
        rest = max(n.sum for n in order)
        heaviest, most = None, LOWERED * rest
        for n in marked:
            own = _weigh(n, kept)
            _densities(own, n)
            weight = max(max(k.sum for k in own), n.density)
            # where there is nothing else, several paragraphs are an article
            if weight > most and (rest > 0 or sum(k.name == "p" and k.chars > 0 for k in own) > 1):
                heaviest, most = n, weight
        if heaviest is None:
            return order
        kept.add(heaviest)


def main_text(page: str | None) -> str:
    """Text of a page's article: blocks in page order joined by one space, white space inside them by one space."""
    if not page:
        return ""
    root = parse(page.replace("\0", ""))
    body = next((k for k in root.kids if not isinstance(k, str) and k.name == "body"), root)
    order = _weighed(body)
    best = max(order, key=lambda n: n.sum)
    if best.sum <= 0:
        best = body
    # the threshold: the smallest density on the way from the densest node up to the body
    n = max(order, key=lambda n: n.density)
    floor, thin = n.density, _thickness(n)
    while n is not None:
        floor, thin = (min(floor, n.density), min(thin, _thickness(n))) if n.name in BLOCK else (floor, thin)
        n = n.up if n is not body else None
    # the core belongs to its article, an inline one to its block, and one with siblings of text to what holds them all
    best = _outermost(best, body, "article") or _outermost(best, body, "main") or best
    while best is not body and (best.name not in BLOCK or any(_text(k, best, floor, thin) for k in best.up.kids)):
        best = best.up
    # lists of links before and after the text go; those inside it belong to it
    listed = [not isinstance(k, str) and k.link_chars > 0.5 * k.chars and k.density < floor for k in best.kids]
    said = [i for i, k in enumerate(best.kids) if not listed[i] and (k.strip() if isinstance(k, str) else k.chars)]
    if said:
        best.kids = [k for i, k in enumerate(best.kids) if not listed[i] or said[0] < i < said[-1]]
    return " ".join(_blocks(best))


def _outermost(n: Node, body: Node, name: str) -> Node | None:
    found = None
    while n is not body:
        found, n = n if n.name == name else found, n.up
    return found


def _thickness(n: Node) -> float:
    """Characters a tag, without links. Unlike density it doesn't grow with a block's size, so leaves and short sections compare."""
    return (n.chars - n.link_chars) / max(n.tags - n.link_tags, 1)


def _text(n: Node | str, best: Node, floor: float, thin: float) -> bool:
    """Whether a sibling of `best` is text of the same article, and no list of links."""
    if isinstance(n, str):
        return not best.headed and len(n.strip()) >= max(thin, 1)
    if n is best or not n.chars or 2 * n.link_chars >= n.chars:
        return False
    if best.headed:  # an article with its headline is whole, but for parts as heavy as its paragraphs
        return n.sum >= floor
    return n.density >= floor or (n.name in BLOCK and _thickness(n) >= thin) or n.headed


def _blocks(top: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [top]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            run.append(n)
        elif n.name == "br":
            run.append("\n")
        else:
            if n.name in BLOCK:
                close()
                stack.append(None)
            stack += reversed(n.kids)
    close()
    return out


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (main text, '' if none) and n_chars (its code points) in place of columns of these names.

    Null, empty and text-free pages give ''. Each row is read on its own, whole, however long or deep; all other columns are
    carried along, so repeated rows and null keys stay as they are. An empty table gives an empty result. No shuffle.
    """
    out = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html)]
    rows = pages.select(*[F.col(f.name) for f in out], F.col(html))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.columns[-1]]
            cols = [*b.columns[: len(out)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out] + ["text", "n_chars"])

    return rows.mapInArrow(run, schema)
