"""Main text of web pages by scoring the tree of their elements."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTRIBUTES = r"""(?:[^<>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|"|')*+"""
#: A comment, a declaration, an end tag or a start tag; anything else is text.
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/<>]*)[^>]*>?|<([a-zA-Z][^\s/<>]*)({_ATTRIBUTES})>", re.S)
_WORDS = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_OUT = {
    "head", "nav", "header", "footer", "aside", "menu", "dialog", "form", "button", "select", "option", "datalist", "label", "fieldset",
    "svg", "math", "canvas", "object", "audio", "video", "map", "applet",
} | _RAW
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "wbr",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_PARAGRAPHS = {"p", "pre", "blockquote", "li", "td", "dd", "dt", "th", "figcaption"}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
} | _HEADINGS
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = {"ul", "ol", "dl", "table", "html", "body"}
#: Words in a class, id or role that mark what isn't the article.
_BOILERPLATE = {
    "ad", "ads", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent",
    "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "replies", "disqus",
    "discussion", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "footer", "masthead", "alert",
    "contentinfo", "complementary", "search", "searchbox", "tablist", "toc", "tags", "skip", "paywall", "respond",
}
#: Words that only say where or what shape something is; next to one of the above they don't change its meaning.
_SHAPES = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "cell", "col", "column", "container", "content", "element", "form", "global", "group",
    "grid", "header", "heading", "holder", "icon", "icons", "inner", "item", "items", "item", "left", "line", "link", "links", "list", "main", "message", "module",
    "outer", "page", "pane", "panel", "posts", "articles", "stories", "primary", "right", "row", "secondary", "section", "side", "site", "slot", "small", "text",
    "thread", "title", "top", "tower", "unit", "user", "view", "wide", "widget", "wrap", "wrapper", "zone",
}
#: The first words of a block of comments.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader |user |leave a |add a |post a )?(?:comments?|responses|replies|reply)\b\W*(?:\(?\d+\)?)?\s*\Z", re.I)
#: A flagged block that holds more than this share of a page's points is its article after all.
_MOST = 0.5


class _Node:
    __slots__ = ("tag", "parent", "children", "out", "flagged", "score", "points", "size", "linked", "links", "left")

    def __init__(self, tag: str, parent: _Node | None, out: bool, flagged: bool = False):
        self.tag, self.parent, self.out, self.flagged = tag, parent, out, flagged
        self.children: list = []  # nodes and texts
        self.score = self.points = 0.0
        self.size = self.linked = self.links = 0
        self.left = False


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes hide it, and whether their words flag it as boilerplate.

    A name flags only if all of its parts are boilerplate or shapes: "ad-slot" does, "notice-of-death" and
    "side-by-side" don't.
    """
    flagged = False
    for name, value in _WORDS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, flagged
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, flagged
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", word)]
                known = [x for x in parts if x in _BOILERPLATE]
                flagged |= bool(known) and all(x in _BOILERPLATE or x in _SHAPES for x in parts)
    return False, flagged


class _Tree:
    """The tree of a page, built in time linear in its length.

    An end tag is looked for only where a count says that its element is open within the frame that it can close, and every
    step of that search closes an element; so stray tags cost nothing.
    """

    def __init__(self):
        self.root = self.node = _Node("#root", None, False)
        # per frame: how many elements of each name are open; blocks bound inline elements, scopes bound paragraphs and items
        self.all: Counter = Counter()
        self.inline: list[Counter] = [Counter()]
        self.scope: list[Counter] = [Counter()]

    def push(self, tag: str, out: bool, flagged: bool) -> None:
        new = _Node(tag, self.node, out, flagged)
        self.node.children.append(new)
        self.node = new
        self.all[tag] += 1
        if tag in _INLINE:
            self.inline[-1][tag] += 1
        else:
            self.inline.append(Counter())
        if tag in _SCOPES:
            self.scope.append(Counter())
        else:
            self.scope[-1][tag] += 1

    def pop(self) -> str:
        tag = self.node.tag
        self.all[tag] -= 1
        if tag in _INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        if tag in _SCOPES:
            self.scope.pop()
        else:
            self.scope[-1][tag] -= 1
        self.node = self.node.parent
        return tag

    def close(self, tag: str) -> None:
        """An end tag."""
        held = self.inline[-1] if tag in _INLINE else self.scope[-1] if tag in ("p", "li") else self.all
        if held[tag] > 0:
            while self.pop() != tag:
                pass

    def imply(self, tag: str) -> None:
        """The ends that a start tag implies."""
        same = _ENDS_SAME.get(tag)
        if same is not None and any(self.scope[-1][x] > 0 for x in same):
            ended = self.pop()
            while ended not in same:
                ended = self.pop()
            if tag == "tr" and ended != "tr" and self.node.tag == "tr":
                self.pop()
        elif tag in _ENDS_P and self.scope[-1]["p"] > 0:
            # only through inline elements: a block inside the paragraph keeps it open
            spans = sum(self.inline[-1].values())
            up = self.node
            for _ in range(spans):
                up = up.parent
            if up.tag == "p":
                while self.pop() != "p":
                    pass

    def text(self, piece: str) -> None:
        if piece and not self.node.out:
            self.node.children.append(unescape(piece))


def _parse(html: str) -> _Node:
    tree, at = _Tree(), 0
    raw_end: dict[str, int] = {}  # where the last search for a raw element's end tag found none
    while m := _MARKUP.search(html, at):
        end, start = m.group(1), m.group(2)
        tree.text(html[at : m.start()])
        at = m.end()
        if end is not None:
            if end.lower() == "br":
                tree.node.children.append(" ")
            else:
                tree.close(end.lower())
        elif start is not None:
            tag = start.lower()
            if tag in _ENDS_P or tag in _ENDS_SAME:
                tree.imply(tag)
            if tag in _RAW:  # raw text until its own end tag
                close = None if tag in raw_end else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                if close is None:
                    raw_end[tag] = at
                at = close.end() if close else len(html)
            elif tag in _VOID:
                if tag in ("br", "hr", "img") and not tree.node.out:
                    tree.node.children.append(" ")
            else:
                hidden, flagged = _marks(m.group(3)) if m.group(3) and tag not in ("html", "body") else (False, False)
                tree.push(tag, tree.node.out or tag in _OUT or hidden, flagged)
    tree.text(html[at:])
    return tree.root


def _order(root: _Node) -> list[_Node]:
    """The nodes that can count, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.out:
            order.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))
    return order


def _density(node: _Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _score(order: list[_Node]) -> None:
    """Points, from the leaves up, each node once.

    A block's own text (with that of its inline elements, not that of blocks inside) makes a paragraph: a point, one for each comma and
    up to three for its length, less the share of linked text. A paragraph element hands its points to its parent; any other
    block has them itself. Half of a container's score goes on to its parent. points counts all paragraphs below a node once.
    """
    own: dict[int, list] = {}  # characters, linked ones and commas of the text that a node passes to its block
    for node in reversed(order):
        chars = linked = commas = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                chars, commas, node.size = chars + n, commas + c.count(","), node.size + n
            elif not c.out:
                node.size += c.size
                node.linked += c.size if c.tag == "a" else c.linked
                node.links += c.links + (c.tag == "a")
                node.score += c.score / 2
                node.points += c.points
                if c.tag in _INLINE:
                    x = own.pop(id(c))
                    chars, linked, commas = chars + x[0], linked + (x[0] if c.tag == "a" else x[1]), commas + x[2]
        if node.tag in _INLINE:
            own[id(node)] = [chars, linked, commas]
        elif chars and node.tag not in _HEADINGS:
            points = (1 + commas + min(chars / 100, 3)) * (1 - linked / chars)
            node.points += points
            # a parent takes half of a child's score, so a paragraph hands on its points whole
            node.score += 2 * points if node.tag in _PARAGRAPHS else points


def _drop(order: list[_Node]) -> None:
    """Leave out blocks of boilerplate: flagged ones without most of the page's points, menus, and comments by their heading."""
    total = order[0].points if order else 0.0
    # what holds the author's article, where there is one with text
    named = [n for n in order if n.tag in ("article", "main") and n.points > 0]
    holds = set()
    for node in named:
        while node is not None and id(node) not in holds:
            holds.add(id(node))
            node = node.parent
    for node in order:
        if node.parent is not None and node.parent.left:
            node.left = True
        elif node.tag not in ("#root", "html", "body"):
            minor = node.points <= _MOST * total or bool(named) and id(node) not in holds
            if node.flagged and minor:
                node.left = True
            elif node.tag not in _INLINE and node.links >= 3 and _density(node) > 0.6 and minor:
                node.left = True
            elif node.tag in _HEADINGS and node.parent.tag in ("section", "div") and minor and _COMMENTS.match(" ".join(_texts(node)[:1])):
                first = next((c for c in node.parent.children if not isinstance(c, str) or c.strip()), None)
                if first is node and node.parent.points <= _MOST * total:
                    node.parent.left = node.left = True


def _texts(node: _Node) -> list[str]:
    """The blocks below a node in page order."""
    blocks, now = [], []

    def flush() -> None:
        words = " ".join("".join(now).split())
        now.clear()
        if words:
            blocks.append(words)

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            now.append(item)
        elif not item.out and not (item is not node and item.left):
            block = item.tag not in _INLINE
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return blocks


def _weight(node: _Node) -> float:
    """What a container's score counts: its author's word for the article counts twice."""
    return node.score * (1 - _density(node)) * (2 if node.tag in ("article", "main") else 1)


def main_text(html: str | None) -> str:
    """The main text of a page: the best container and the siblings that belong to it."""
    root = _parse(html or "")
    order = _order(root)
    _score(order)
    _drop(order)
    kept = [n for n in order if not n.left]
    best = max((n for n in kept if n.tag not in _INLINE), key=_weight, default=root)
    if best.score <= 0:
        return " ".join(_texts(root))
    # as long as other plain text stands beside it, the container above is the article's, too
    while best.tag not in ("article", "main", "body", "html") and best.parent is not None and best.parent.tag not in ("html", "#root"):
        up = best.parent
        if up.tag == "body":
            return " ".join(t for c in up.children for t in _sibling(c, best))
        best = up
    return " ".join(_texts(best))


def _sibling(child: _Node | str, best: _Node) -> list[str]:
    """The texts of a child of the body: the best container, and what has plain paragraphs or headings of its own."""
    if isinstance(child, str):
        return [" ".join(child.split())] if child.strip() else []
    plain = child.tag in _HEADINGS or child.tag in _INLINE or child.score > 0 and _density(child) < 0.25
    return _texts(child) if child is best or (not child.out and not child.left and plain) else []


def _extract(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for k in range(0, b.num_rows, 64):
            part = b.slice(k, 64)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extract the main text of every page.

    Elements form a tree, with the usual implied end tags. Paragraphs pass points for their length and
    commas to their ancestors, by half from level to level, discounted by the share of linked text; the container with the most
    points is kept with the siblings that hold plain text, an article or main element with twice its points. Menus, forms, scripts and the like are left out by their
    elements; blocks whose class, id or role names boilerplate, menus by link density, and comments by their
    heading, unless they hold most of the page's points. Time is linear in a page's length, whatever its markup. Pages are independent of each
    other: nothing is shuffled.

    Cases: a null or empty page, or one without text, gives an empty text. Cut-off markup is read as far
    as it goes. Null or repeated ids and urls pass through. Other columns are ignored. An empty table gives an
    empty result.

    Returns page_id, url, text, n_chars: one row per input row.
    """
    columns = [F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
