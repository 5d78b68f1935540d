"""Main-text extraction from HTML by tree scoring.

Paragraphs give points for their length and commas to their parent and, in
smaller parts, to ancestors further up; a container's points are discounted
by the share of its text that stands in links.  The container with the most
points is kept, with siblings that score near it or read like its paragraphs.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
_SPACE = re.compile(r"\s+")

# fixed values of HTML: elements without content, with raw text, that break lines, and that end an open paragraph
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - {"br", "body", "html", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "legend", "summary"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article aside blockquote body dd details div fieldset figure footer form header li main nav section table tbody td ul ol dl".split())
# parts of a page that never belong to its article
DROPPED = frozenset("script style noscript template iframe title head nav footer aside form button select textarea input svg canvas object embed dialog menu".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead"
    " comment comments replies reply disqus cookie cookies consent gdpr notice popup modal newsletter subscribe subscription social share sharing related recommend recommended recommendations"
    " widget widgets pagination pager login signup skip skiplink".split()
)
# parts of a name that say what kind of box it is, or where, and not what is in it
BOX_NAMES = frozenset(
    "area bar bars block blocks bottom box boxes btn button buttons center column container content cta col form grid group holder icon icons inner item items left link links list lists main"
    " menu nav outer overlay panel placeholder popup modal post posts articles stories region right row section sections site slot text top title toolbar unit widget wrap wrapper thread body primary secondary mobile desktop".split()
)
# a name that starts so speaks of the page's layout or state; one of the second kind of an article's own parts
LAYOUT_NAMES = frozenset("has with no without is layout show hide hidden enable disable".split())
ARTICLE_NAMES = frozenset("entry article post story blog content single".split())
COMMENT_NAMES = frozenset("comment comments replies reply disqus".split())
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())


#: A part of the page that its name alone would drop stays if it holds so many times the text of all that is left.
GUARD = 4
#: What list items, table cells and paragraphs end at, or look for.
_ITEMS = frozenset("li dt dd tr td th option ul ol dl table select".split())


class Node:
    """An element.  ``item`` and ``block`` are the nearest list or table part, and paragraph or container, from itself up."""

    __slots__ = ("block", "commas", "dropped", "item", "links", "named", "parent", "parts", "points", "size", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: bool = False):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped or named, named and not dropped
        self.parts: list[Node | str] = []
        self.points, self.size, self.links, self.commas, self.total = 0.0, 0, 0, 0, 0.0
        self.item = self if parent is None or tag in _ITEMS else parent.item
        self.block = self if parent is None or tag == "p" or tag in CONTAINERS else parent.block


def _named(value: str) -> str | None:
    """The name for which a class or id says that its element is no part of an article.

    Each name of the value counts as a whole: it is such a name itself, ends in
    one (site-header, but not has-sidebar or entry-header), or starts with one
    and goes on with words for boxes only (share-buttons, but not social-science).
    """
    for name in value.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        parts = [p for p in parts if not p.isdigit()]
        if not parts or parts[0] in LAYOUT_NAMES:
            continue
        if parts[-1] in DROPPED_NAMES and (len(parts) == 1 or parts[0] not in ARTICLE_NAMES or parts[-1] not in ("header", "notice", "banner", "content")):
            return parts[-1]
        if parts[0] in DROPPED_NAMES and all(p in BOX_NAMES or p in DROPPED_NAMES for p in parts[1:]):
            return parts[0]
        if len(parts) > 2 and parts[1] in DROPPED_NAMES and parts[0] not in ARTICLE_NAMES and all(p in BOX_NAMES for p in parts[2:]):
            return parts[1]
    return None


def _name_of(tag: str, attributes: str) -> str | None:
    if not attributes or tag in ("body", "html", "article", "main"):
        return None
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id") and (found := _named("".join(values))):
            return found
    return None


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return "hidden" in attributes.lower().split() if attributes else False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "role" and value.lower() in DROPPED_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return "hidden" in re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes).lower().split()


def parse(page: str) -> Node:
    """A tree of elements and decoded texts; end tags may be missing or stray."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()  # open elements by name, so that an end tag without a start is told at once
    at = 0

    def leave(up: Node) -> Node:
        """Closes the open elements up to ``up``; returns its parent."""
        inner = node
        while inner is not up.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return inner

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            node.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.parts.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if m[1]:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            elif tag == "p":
                node.parts.append(Node("br", node))
            continue
        if tag in ENDS_PARAGRAPH and opened["p"]:
            if node.block.tag == "p":
                node = leave(node.block)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            up = node.item
            while up is not root and up.tag not in CLOSES[tag] and up.tag not in ("ul", "ol", "dl", "table", "select"):
                up = up.parent.item
            if up.tag in CLOSES[tag]:
                node = leave(up)
        if tag in ("html", "body") and any(isinstance(x, Node) and x.tag == tag for x in root.parts) or tag == "html":
            continue
        # the header of a page goes, that of an article is part of it
        inside = opened["article"] or opened["main"]
        attributes = m[3] or ""
        name = None if tag == "header" and inside else _name_of(tag, attributes)
        # readers' comments go however long they are; other names yield to a page that has no text without them
        never = tag == "header" and not inside or _dropped(tag, attributes) or name in COMMENT_NAMES
        own = Node(tag, node, never, name is not None)
        node.parts.append(own)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            node = own
            opened[tag] += 1
    if at < len(page):
        node.parts.append(html.unescape(page[at:]))
    return root


def _measure(root: Node, top: bool = False) -> list[Node]:
    """Sizes, link sizes and commas of every node that is not dropped (``top``: but the first), children first; returns them in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped or top and node is root:
            order.append(node)
            stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    for node in reversed(order):
        node.size = node.links = node.commas = 0
        for x in node.parts:
            if isinstance(x, str):
                text = x.strip()
                node.size += len(text)
                node.commas += text.count(",") + text.count("，") + text.count("、")
            elif not x.dropped:
                node.size += x.size
                node.links += x.links
                node.commas += x.commas
        if node.tag == "a":
            node.links = node.size
    return order


def _readmit(root: Node) -> None:
    """Parts dropped for their name alone come back where they hold nearly all the text outside links."""
    while True:
        _measure(root)
        plain, largest, most = root.size - root.links, None, 0
        stack = [root]
        while stack:
            node = stack.pop()
            if node.named:
                _measure(node, True)
                if node.size - node.links > most:
                    largest, most = node, node.size - node.links
            elif not node.dropped:
                stack.extend(x for x in node.parts if isinstance(x, Node))
        if largest is None or most <= GUARD * max(plain, 1):
            return
        largest.dropped = largest.named = False


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def best_container(root: Node) -> list[Node]:
    """The nodes to keep: the best container and the siblings that belong to it, in page order."""
    _readmit(root)
    order = _measure(root)
    for node in order:
        blocks = any(isinstance(x, Node) and not x.dropped and x.tag in BLOCK and x.tag != "br" for x in node.parts)
        if node.tag in ("p", "pre", "blockquote") or node.tag in ("div", "td", "section", "article", "main", "li") and not blocks:
            if node.size == 0 or node.tag == "li" and _density(node) > 0.3:
                continue
            points = 1 + node.commas + min(node.size / 100, 3)
            if node.tag not in ("p", "pre", "blockquote"):
                node.points += points
            node.total = points
            up, share = node.parent, 1.0
            for level in range(4):
                if up is None:
                    break
                up.points += points * share
                up, share = up.parent, 0.5 if level == 0 else share / 3
    marks = {"article": 25, "main": 20, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "li": -3, "ul": -3, "ol": -3, "dl": -3}
    ranked = [(node, (node.points + marks.get(node.tag, 0)) * (1 - _density(node))) for node in order if node.tag in CONTAINERS or node is root]
    ranked = [(n, s) for n, s in ranked if n.size and (n.points or n.tag in ("article", "main"))]
    if not ranked:
        return [root]
    best, top = max(ranked, key=lambda r: r[1])
    if best.parent is None:
        return [best]
    scores = dict((id(n), s) for n, s in ranked)
    for node in reversed(order):
        node.total += sum(x.total for x in node.parts if isinstance(x, Node) and not x.dropped)

    def belongs(x: Node | str, level: int) -> bool:
        if isinstance(x, str) or x.dropped:
            return False
        near = scores.get(id(x), 0.0) >= max(10.0, 0.2 * top) and _density(x) < 0.3
        # text in wrappers of its own counts with all the paragraphs inside
        wraps = x.tag in CONTAINERS and x.total >= max(5.0, 0.2 * best.total) and _density(x) < 0.2
        reads = level == 0 and x.tag == "p" and (x.size > 80 and _density(x) < 0.25 or 0 < x.size <= 80 and x.links == 0 and x.commas > 0)
        return near or wraps or reads

    path, kept = best, [best]
    for level in range(3):
        if path.parent is None:
            break
        place = next(k for k, x in enumerate(path.parent.parts) if x is path)
        before, after = path.parent.parts[:place], path.parent.parts[place + 1 :]
        kept = [x for x in before if belongs(x, level)] + kept + [x for x in after if belongs(x, level)]
        path = path.parent
    return kept


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, white space in each made one space, joined by one space."""
    pieces: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                pieces.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.parts))
    return _SPACE.sub(" ", "".join(pieces)).strip()


def extract(page: str | None) -> str:
    """The main text of a whole page; null and empty pages, and pages without text, give the empty text."""
    return text_of(best_container(parse(page))) if page else ""


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages with ``out_col``, their main text; all columns but a former ``out_col`` are kept, repeated rows too."""

    def run(values):
        return values.map(extract)

    udf = F.pandas_udf(run, "string").asNondeterministic()
    return pages.withColumn(out_col, udf(F.coalesce(F.col(html_col), F.lit(""))))
