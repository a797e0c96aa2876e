"""HTML extraction with wrappers that are inferred from pages of the same host as union-free regular expressions.

A page is a tree of elements and texts. The wrapper of a host is one generalised tree: aligned pages share what they have in common; what only
some of them have is optional, neighbours that match each other are repeated, and texts are slots. Wrappers are merged over all pages: within
tasks, then within parts of a host, then for the host. A page is matched against its host's wrapper, and the text of what matches its content
nodes is the main text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from zlib import crc32

import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import join_counted, materialize, private_names, slices

# Fixed values of HTML: elements without content, elements that end an open paragraph, elements that end their own kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements of layout, which hold anything.
BOXES = frozenset("article body div main section table td".split())
BOXES_INSIDE = frozenset("div section table td".split())
CLOSES_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements that hold no main text; words in class, id or role that say that readers wrote it; and words that may say the same of other text, or name
#: a subject: these are believed of small parts only.
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea option iframe object svg canvas audio video dialog menu".split())
READERS_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
DOUBTFUL_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended search widget toolbar pagination pager skip".split()
)
#: A class that begins so says what a page has or lacks, not what the element is.
ABOUT_OTHERS = frozenset("has no with without not hide".split())
ROOTS = ("article", "main")
#: Levels of nesting that a wrapper tells apart, and neighbours; beyond that neighbours are told apart by their symbols only, in any order.
DEPTH, KIDS = 120, 128
#: Pages of a form that must agree before a text inside of articles is the template's own.
AGREE = 5
#: All wrappers together are sent to all executors up to so many bytes; beyond that pages meet them by host.
BROADCAST_BYTES = 16_000_000
#: So many forms of pages of a host are added up in a task before they are merged.
FORMS = 64
#: Wrappers of tasks are merged within so many parts of a host first.
PARTS = 256


#: What :func:`_doubt` says of an element.
SURE, DOUBTFUL, GONE = 0, 1, 2


def _doubt(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Whether an element is GONE in any case, or DOUBTFUL by its words."""
    if tag in DROPPED:
        return GONE
    out = SURE
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in ("html", "body", *ROOTS):
            if value.lower() in ("complementary", "contentinfo"):
                return GONE
            for words in (re.split(r"[^a-z0-9]+", x) for x in value.lower().split()):
                if words[0] not in ABOUT_OTHERS:
                    if not READERS_WORDS.isdisjoint(words):
                        return GONE
                    if not DOUBTFUL_WORDS.isdisjoint(words):
                        out = DOUBTFUL
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return GONE
    return out


class Reader(HTMLParser):
    """Calls open(), shut() and text() for a well-nested page, whatever tags are left open; what is in elements that are gone is passed over.

    ``stack`` holds tags and symbols: the tag and its first class; ``places`` where in it each tag stands, so that no end tag searches the stack. The page is
    itself a body: text may stand outside of all elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.dropped: list[int] = []

    def open(self, symbol: str, tag: str, doubtful: bool) -> None: ...

    def shut(self, symbol: str, tag: str) -> None: ...

    def text(self, data: str) -> None: ...

    def updatepos(self, i: int, j: int) -> int:
        return j  # no line numbers are asked for

    def _pop(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            tag, symbol = self.stack.pop()
            self.places[tag].pop()
            if self.dropped and self.dropped[-1] >= len(self.stack):
                self.dropped.pop()
            elif not self.dropped:
                self.shut(symbol, tag)

    def _last(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> int | None:
        """Where the last of ``tags`` is open, unless one of ``stop`` is open inside of it."""
        at = -1
        for t in tags:
            if (places := self.places.get(t)) and places[-1] > at:
                at = places[-1]
        if at < 0 or any((places := self.places.get(t)) and places[-1] > at for t in stop):
            return None
        return at

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag != "br" and self.places.get("p") and (at := self._last(("p",), ("table", "td", "button", "article", "section", "div", "li", "body"))) is not None:
            self._pop(at)
        if tag in CLOSES_SELF:
            like = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if (at := self._last(like, CLOSES_SELF[tag])) is not None:
                self._pop(at)
        if tag == "body" and (at := self._last(("head",), ())) is not None:
            self._pop(at)
        first = next((v.split()[0].lower() for k, v in attrs if k == "class" and v and v.strip()), "") if attrs else ""
        symbol = f"{tag}.{first}" if first else tag
        doubt = GONE if tag == "header" and self._last(ROOTS, ()) is None else _doubt(tag, attrs)
        if tag in VOID:
            if not self.dropped and doubt != GONE:
                self.open(symbol, tag, False)
                self.shut(symbol, tag)
            return
        if not self.dropped and doubt != GONE:
            self.open(symbol, tag, doubt == DOUBTFUL)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, symbol))
        if doubt == GONE:
            self.dropped.append(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if places := self.places.get(tag):
            self._pop(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text(data)

    def read(self, page: str) -> None:
        self.feed(page)
        self.close()
        self._pop(0)


@dataclass(slots=True)
class Node:
    """A part of a wrapper or page. ``symbol`` is "#" for a text slot. ``size`` counts characters of texts seen, ``same`` is a hash of a slot's only
    text so far. ``loose`` kids are told apart by symbol, in any order. ``doubtful``: an outermost element with a doubtful word; ``fixed``: a box inside of
    an article with the same text on all pages. In a page, ``spans`` say where the node lies among the page's events."""

    symbol: str
    kids: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    loose: bool = False
    size: int = 0
    same: int | None = None
    content: bool = False
    doubtful: bool = False
    fixed: bool = False
    spans: list[tuple[int, int]] = field(default_factory=list)

    def written(self) -> str:
        """The wrapper as an expression: ( ) for content, ? for optional, + for repeated, # for a text slot, | | for kids in any order."""
        kids = " ".join(k.written() for k in self.kids)
        return self.symbol + (f"|{kids}|" if self.loose else f"({kids})" if kids else "") + "+" * self.repeated + "?" * self.optional

    def packed(self) -> list:
        return [self.symbol, self.optional + 2 * self.repeated + 4 * self.loose + 8 * self.content + 16 * self.doubtful + 32 * self.fixed, self.size, self.same, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Node:
        symbol, flags, size, same, kids = x
        return Node(symbol, [Node.unpacked(k) for k in kids], bool(flags & 1), bool(flags & 2), bool(flags & 4), size, same, bool(flags & 8), bool(flags & 16), bool(flags & 32))


def _tag(symbol: str) -> str:
    return symbol.split(".", 1)[0]


def common(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places in both lists of a longest common part, by symbols."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first].symbol == b[first].symbol:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last].symbol == b[-1 - last].symbol:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].symbol == y[j].symbol else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [(k, k) for k in range(first)], 0, 0
    while i < len(x) and j < len(y):
        if x[i].symbol == y[j].symbol:
            out.append((first + i, first + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list for two: nodes in the longest common part are merged; those that only one list has become optional, in their places."""
    out, i, j = [], 0, 0
    for at, with_ in [*common(a, b), (len(a), len(b))]:
        for node in [*a[i:at], *b[j:with_]]:
            node.optional = True
            out.append(node)
        if at < len(a):
            out.append(merge(a[at], b[with_]))
        i, j = at + 1, with_ + 1
    return out


def merge(a: Node, b: Node) -> Node:
    """One node for two, which are used up."""
    a.spans.extend(b.spans)
    kids, loose = a.kids + b.kids, a.loose or b.loose
    if kids and not loose:
        kids = fold(align(a.kids, b.kids))
    node = Node(a.symbol, kids, a.optional or b.optional, a.repeated or b.repeated, loose, a.size + b.size, a.same if a.same == b.same else None, doubtful=a.doubtful and b.doubtful, spans=a.spans)
    return settled(node)


def settled(node: Node) -> Node:
    """A node with too many kids keeps one for each symbol; if these are too many, one for each tag; if those are, a single one."""
    if not node.loose and len(node.kids) <= KIDS:
        return node
    name = next(f for f in (str, _tag, lambda symbol: "*") if len({f(k.symbol) for k in node.kids}) <= KIDS)
    by: dict[str, Node] = {}
    for kid in node.kids:
        kid.symbol, kid.optional, kid.repeated = name(kid.symbol), True, True
        by[kid.symbol] = merge(by[kid.symbol], kid) if kid.symbol in by else kid
    node.kids, node.loose = list(by.values()), True
    return node


def _alike(a: Node, b: Node) -> bool:
    """Whether two neighbours can be one repeated node: boxes only where they have nothing in them or something in common."""
    if a.symbol != b.symbol:
        return False
    return _tag(a.symbol) not in BOXES or not a.kids or not b.kids or not {k.symbol for k in a.kids}.isdisjoint(k.symbol for k in b.kids)


def fold(kids: list[Node]) -> list[Node]:
    """Runs of one to four nodes that follow themselves become one repeated run, merged."""
    out: list[Node] = []
    for kid in kids:
        out.append(kid)
        for n in range(1, 5):
            if len(out) >= 2 * n and (n > 1 or kid.symbol != "#") and all(_alike(x, y) for x, y in zip(out[-2 * n : -n], out[-n:], strict=True)):
                runs = [merge(x, y) for x, y in zip(out[-2 * n : -n], out[-n:], strict=True)]
                for k in runs:
                    k.repeated = True
                out[-2 * n :] = runs
                break
    return out


def least_believed(sizes: list[int], rest: int) -> int:
    """How large a doubtful part must be to be main text: the largest is if it is more than twice the rest, which it then belongs to, and so on down."""
    least = max(sizes, default=0) + 1
    for size in sorted(sizes, reverse=True):
        if size <= 2 * rest:
            break
        least, rest = size, rest + size
    return least


class Page(Reader):
    """A page as nodes, and its events: texts in their order, and None where a block begins or ends.

    What is nested deeper than DEPTH belongs to the node there. Articles, and main elements without one, and outermost doubtful elements are noted
    beside the tree, with their places among the events and their size, however deep they lie. ``marked``: the page has an article or main
    element. ``telling``: an article has doubtful elements, or texts right in a box. Without ``tree`` there are no nodes.
    """

    def __init__(self, page: str | None, tree: bool = True) -> None:
        super().__init__()
        self.tree = tree
        self.root = Node("")
        self.at = [self.root]
        self.deeper = 0
        self.marked = self.telling = False
        self.events: list[str | None] = []
        self.chars = 0
        self.roots: list[list] = []  # open: tag, first event, characters before, whether it has one inside, whether it is in a doubtful one
        self.articles: list[tuple[int, int, int, bool]] = []  # first and last event, size, whether in a doubtful one
        self.doubts: list[tuple[int, int, int]] = []
        self.doubt: tuple[int, int, int] | None = None  # the open outermost one: depth, first event, characters before
        self.level = 0
        self.read(page or "")
        self.root.kids = fold(self.root.kids)
        self.root.size = sum(k.size for k in self.root.kids)
        settled(self.root)

    def open(self, symbol: str, tag: str, doubtful: bool) -> None:
        if tag in BLOCK:
            self.events.append(None)
        self.level += 1
        if tag in ROOTS:
            self.marked = True
            self.roots.append([tag, len(self.events), self.chars, False, self.doubt is not None])
        outermost = doubtful and self.doubt is None
        if outermost:
            self.doubt = self.level, len(self.events), self.chars
            self.telling |= bool(self.roots)
        if not self.tree:
            return
        if len(self.at) > DEPTH:
            self.deeper += 1
        else:
            self.at.append(Node(symbol, doubtful=outermost, spans=[(len(self.events), 0)]))

    def shut(self, symbol: str, tag: str) -> None:
        if self.doubt is not None and self.doubt[0] == self.level:
            self.doubts.append((self.doubt[1], len(self.events) + (tag in BLOCK), self.chars - self.doubt[2]))
            self.doubt = None
        self.level -= 1
        if tag in BLOCK:
            self.events.append(None)
        if tag in ROOTS:
            _, first, before, inner, doubted = self.roots.pop()
            inside = any(r[0] == "article" for r in self.roots)
            if not inside and not (tag == "main" and inner):
                self.articles.append((first, len(self.events), self.chars - before, doubted))
                for r in self.roots:
                    r[3] = True
        if not self.tree:
            return
        if self.deeper:
            self.deeper -= 1
            return
        node = self.at.pop()
        node.spans = [(node.spans[0][0], len(self.events))]
        node.kids = fold(node.kids)
        node.size = sum(k.size for k in node.kids)
        self.at[-1].kids.append(settled(node))

    def text(self, data: str) -> None:
        self.events.append(data)
        if words := " ".join(data.split()):
            self.chars += len(words)
            if not self.tree:
                return
            kids, span = self.at[-1].kids, (len(self.events) - 1, len(self.events))
            self.telling |= bool(self.roots) and _tag(self.at[-1].symbol) in BOXES_INSIDE
            if kids and kids[-1].symbol == "#":
                kids[-1].size += len(words)
                kids[-1].same = crc32(words.encode(errors="replace"), kids[-1].same)
                kids[-1].spans.append(span)
            else:
                kids.append(Node("#", size=len(words), same=crc32(words.encode(errors="replace")), spans=[span]))

    def own(self) -> tuple[list[tuple[int, int]], dict[tuple[int, int], bool]]:
        """Where the page's articles are (those in doubtful elements only if there are no others), and of the doubtful elements in them whether they are main
        text, by this page alone. Of a page without articles it is the whole page."""
        if not self.marked:
            found = [(0, len(self.events), self.chars, False)]
        else:
            found = [x for x in self.articles if not x[3]] or self.articles
        inside = [d for d in self.doubts if any(a <= d[0] and d[1] <= b for a, b, _, _ in found)]
        least = least_believed([d[2] for d in inside], sum(x[2] for x in found) - sum(d[2] for d in inside))
        return [(a, b) for a, b, _, _ in found], {(a, b): size >= least for a, b, size in inside}

    def blocks(self, spans: list[tuple[int, int]], without: list[tuple[int, int]]) -> str:
        """The texts in ``spans``, less those in ``without``: white space inside a block made one space, blocks joined by newlines."""
        out, parts, done = [], [], 0
        dropped = {i for a, b in without for i in range(a, b)}

        def end() -> None:
            if words := " ".join("".join(parts).split()):
                out.append(words)
            parts.clear()

        for first, last in sorted(spans):
            for i in range(max(first, done), last):
                if self.events[i] is None:
                    end()
                elif i not in dropped:
                    parts.append(self.events[i])
            done = max(done, last)
            end()
        return "\n".join(out)


class Wrapper:
    """The expressions of a host's pages: one of pages with an article or main element, one of pages without; None where there was no such page."""

    def __init__(self) -> None:
        self.of: dict[bool, Node | None] = {True: None, False: None}
        self.pages = {True: 0, False: 0}
        self.seen: set[int] = set()
        self.again: dict[str, tuple[Node, list[int]]] = {}  # sums of pages by forms that were seen, and how many pages
        self._least: int | None = None
        self._tells: bool | None = None

    def add(self, page: Page) -> None:
        """Merge a page in. Marked pages with nothing to tell inside of their articles, whose form was seen, are alike node by node: they are added up before they are merged."""
        if page.marked and not page.telling:
            form = page.root.written()
            if form in self.again:
                node, pages = self.again[form]
                _add_up(node, page.root)
                pages[0] += 1
                return
            if hash(form) in self.seen:
                _without_spans(page.root)
                self.again[form] = page.root, [1]
                if len(self.again) > FORMS:
                    self.settle()
                return
            self.seen.add(hash(form))
        _without_spans(page.root)
        self._take(page.marked, page.root, 1)

    def settle(self) -> None:
        """Merge in what was added up."""
        for node, pages in self.again.values():
            self._take(True, node, pages[0])
        self.again.clear()

    def _take(self, marked: bool, node: Node, pages: int) -> None:
        here = self.of[marked]
        self.of[marked] = node if here is None else merge(here, node)
        self.pages[marked] += pages

    def take(self, other: Wrapper) -> None:
        other.settle()
        for marked, node in other.of.items():
            if node is not None:
                self._take(marked, node, other.pages[marked])

    def packed(self) -> str:
        self.settle()
        return json.dumps([[None if n is None else n.packed(), self.pages[m]] for m, n in self.of.items()], separators=(",", ":"))

    @staticmethod
    def unpacked(text: str | None) -> Wrapper:
        out = Wrapper()
        for marked, (node, pages) in zip((True, False), json.loads(text) if text else [(None, 0)] * 2, strict=True):
            out.of[marked], out.pages[marked] = node and Node.unpacked(node), pages
        return out

    def written(self) -> str:
        self.settle()
        return " ; ".join(" ".join(k.written() for k in n.kids) for n in self.of.values() if n is not None)

    def finish(self) -> Wrapper:
        """Mark the content nodes, and leave out what is not on the way to one.

        With articles: all outermost article elements, and main elements without an article; inside of them what is doubtful, and boxes that have the
        same text on all of AGREE pages or more. Without: the deepest element that has three fifths of the varying text; if that is
        none, all slots but those that had the same text on all of the host's pages of this form, three or more.
        """
        self.settle()
        if (node := self.of[True]) is not None:
            _mark_articles(node)
            _prune(node, self.pages[True] >= AGREE)
        if (node := self.of[False]) is not None:
            _mark_varying(node, self.pages[False] >= 3)
            if not node.content:
                _prune(node, False)
        return self

    def least(self) -> int:
        """How large, over all merged pages, a doubtful part of articles must be to be main text."""

        def count(node: Node, inside: bool) -> int:
            if inside and node.doubtful:
                sizes.append(node.size)
                return -node.size
            own = node.size if node.content and not inside else 0
            return own + sum(count(k, inside or node.content) for k in node.kids)

        if self._least is None:
            sizes: list[int] = []
            rest = count(self.of[True], False) if self.of[True] is not None else 0
            self._least = least_believed(sizes, rest)
        return self._least

    def needs_tree(self) -> bool:
        """Whether matching a page against the wrapper can tell more than the page's own articles."""

        def tells(node: Node) -> bool:
            return node.doubtful or node.fixed or any(tells(k) for k in node.kids)

        if self._tells is None:
            self._tells = self.of[False] is not None or (self.of[True] is not None and tells(self.of[True]))
        return self._tells


def _without_spans(node: Node) -> None:
    node.spans = []
    for kid in node.kids:
        _without_spans(kid)


def _add_up(a: Node, b: Node) -> None:
    """Add the sizes of a tree to those of one of the same form."""
    a.size += b.size
    if a.same != b.same:
        a.same = None
    a.doubtful = a.doubtful and b.doubtful
    for x, y in zip(a.kids, b.kids, strict=True):
        _add_up(x, y)


def _mark_articles(node: Node) -> bool:
    """Whether there is a content node in or at ``node``, after marking."""
    if _tag(node.symbol) == "article":
        node.content = True
        return True
    inside = [_mark_articles(k) for k in node.kids]
    if not any(inside) and _tag(node.symbol) == "main":
        node.content = True
    return node.content or any(inside)


def _mark_varying(whole: Node, several: bool) -> None:
    def vary(node: Node) -> int:
        if node.symbol == "#":
            return 0 if several and node.same is not None and not node.optional else node.size
        return sum(vary(k) for k in node.kids if believed or not k.doubtful)

    believed = False
    without = vary(whole)
    believed = True
    node, total = whole, vary(whole)
    if 3 * without >= total:
        believed, total = False, without
    while True:
        best = max((k for k in node.kids if k.symbol != "#"), key=vary, default=None)
        if best is None or _tag(best.symbol) not in ("html", "body", "div", "section", "table", "tbody", "tr", "td") or 5 * vary(best) < 3 * total or not total:
            break
        node = best
    node.content = True
    if node is whole:  # no element has the main text: what is not the template's own text is all that can be told
        stack = [(whole, False)]
        while stack:
            node, optional = stack.pop()
            optional = optional or node.optional
            if node.symbol == "#" and (not several or optional):
                node.same = None
            stack += [(k, optional) for k in node.kids]


def _prune(node: Node, agreed: bool, inside: bool = False) -> bool:
    """Leave only symbols of nodes that say nothing: all but content nodes, what is above them, and what is doubtful or fixed in them."""
    if inside and agreed and _tag(node.symbol) in BOXES_INSIDE and not node.doubtful and _is_fixed(node):
        node.fixed = True
        return True
    inner = inside or node.content
    if node.content and not inside:
        agreed = agreed and _varies(node)  # pages that are copies of each other show no template
    kept = False if inside and node.doubtful else any([_prune(k, agreed, inner) for k in node.kids])
    if not kept:
        node.kids, node.loose = [], False
    return kept or node.content or (inside and node.doubtful)


def _varies(node: Node) -> bool:
    return node.size > 0 and node.same is None if node.symbol == "#" else any(_varies(k) for k in node.kids)


def _is_fixed(node: Node) -> bool:
    """Whether all texts of a node, one at least, were the same on all pages."""
    if node.symbol == "#":
        return node.same is not None and not node.optional
    return node.size > 0 and not node.optional and not node.repeated and not node.loose and all(k.symbol != "#" and not k.size or _is_fixed(k) for k in node.kids)


def _same_text(page: Node, node: Node) -> bool:
    """Whether a page's node has the texts of a fixed one."""
    if page.symbol != node.symbol or len(page.kids) != len(node.kids) or page.loose:
        return False
    return page.same == node.same if page.symbol == "#" else all(_same_text(k, w) for k, w in zip(page.kids, node.kids, strict=True))


def matched(kids: list[Node], loose: bool, node: Node) -> list[tuple[Node, Node]]:
    """Which of a page's nodes match which kids of a wrapper's node."""
    if loose or node.loose:
        by = {k.symbol: k for k in reversed(node.kids)}
        found = ((k, by.get(k.symbol) or by.get(_tag(k.symbol)) or by.get("*")) for k in kids)
        return [(k, w) for k, w in found if w is not None]
    return [(kids[i], node.kids[j]) for i, j in common(kids, node.kids)]


def _regions(page: Node, node: Node) -> list[tuple[int, int]]:
    """Where a page has what matches the content nodes of a wrapper."""
    out = []
    for k, w in matched(page.kids, page.loose, node):
        out += k.spans if w.content else _regions(k, w) if w.kids else []
    return out


def _constants(page: Node, node: Node) -> list[tuple[int, int]]:
    """Where a page has texts that are the template's own."""
    out = []
    for k, w in matched(page.kids, page.loose, node):
        out += _constants(k, w) if k.symbol != "#" else k.spans if w.same is not None and w.same == k.same else []
    return out


def _judged(page: Node, node: Node, least: int, out: dict[tuple[int, int], bool], optional: bool = False) -> None:
    """For each doubtful or fixed part of a page that matches one of the wrapper's, whether it is main text: a doubtful part is if all pages together have
    as much text in it as it takes (:func:`least_believed`)."""
    for k, w in matched(page.kids, page.loose, node):
        maybe = optional or w.optional
        if w.doubtful and k.doubtful and w.size:
            out.update((span, w.size >= least) for span in k.spans)
        elif w.fixed and not maybe and _same_text(k, w):
            out.update((span, False) for span in k.spans)
        elif w.kids:
            _judged(k, w, least, out, maybe)


def main_text(page: str | None, wrapper: Wrapper | None = None) -> tuple[str, bool]:
    """The main text, and whether the wrapper decided it: whether without it the text would be another.

    Of a page with articles it is these, less the parts that the wrapper knows not to be main text; of what the wrapper does not know, a doubtful part is
    main text if it is more than twice the rest of the page's articles. Of other pages it is what matches the wrapper's content nodes, else
    the page as a whole.
    """
    read = Page(page, wrapper is not None and wrapper.needs_tree())
    spans, alone = read.own()
    gone = lambda known: [k for k, keep in known.items() if not keep]
    plain = read.blocks(spans, gone(alone)) or read.blocks(spans, [])
    node = wrapper.of[read.marked] if wrapper and read.tree else None
    text = ""
    if node is not None and read.marked:
        judged: dict[tuple[int, int], bool] = {}
        _judged(read.root, node, wrapper.least(), judged)
        known = alone | {k: v for k, v in judged.items() if any(a <= k[0] and k[1] <= b for a, b in spans)}
        text = plain if known == alone else read.blocks(spans, gone(known))
    elif node is not None and node.content:
        text = read.blocks(spans, [*_constants(read.root, node), *gone(alone)])
    elif node is not None:
        regions = _regions(read.root, node)
        # what is doubtful around a content node is content with it
        text = read.blocks(regions, [d for d in gone(alone) if not any(d[0] <= a and b <= d[1] for a, b in regions)])
    if text:
        return text, text != plain
    return plain or read.blocks([(0, len(read.events))], gone(alone)) or read.blocks([(0, len(read.events))], []), False


def infer_wrapper(pages: list[str]) -> Wrapper:
    """The finished wrapper of some pages."""
    out = Wrapper()
    for page in pages:
        out.add(Page(page))
    return out.finish()


def host_of(url: str | F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (host, wrapper, expression, n_pages): the wrapper of each host, inferred from all of its pages.

    Every task merges the pages that it reads into a wrapper for each host; these are merged within PARTS parts of a host, then for the host. So a
    host with a third of all pages sends one wrapper a task, whose size is bounded by DEPTH and KIDS. A null url is the host "". Null pages are
    empty.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known: dict[str, Wrapper] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known.setdefault(host, Wrapper()).add(Page(page.as_py()))
        part = TaskContext.get().partitionId()
        for host, wrapper in known.items():
            rows = [[host], [part], [wrapper.packed()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["host", "part", "wrapper"])

    def join(pdf: pd.DataFrame) -> Wrapper:
        out = Wrapper()
        for text in pdf.sort_values("part")["wrapper"]:
            out.take(Wrapper.unpacked(text))
        return out

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["part"].iloc[0] % PARTS], "wrapper": [join(pdf).packed()]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = join(pdf)
        expression = out.written()
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [out.finish().packed()], "expression": [expression], "n_pages": [sum(out.pages.values())]})

    learnt = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(learn, "host string, part int, wrapper string")
    parts = learnt.groupBy("host", F.pmod("part", F.lit(PARTS))).applyInPandas(within, "host string, part int, wrapper string")
    return parts.groupBy("host").applyInPandas(last, "host string, wrapper string, expression string, n_pages bigint")


@private_names
def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each page, blocks joined by newlines, white space inside a block made one space; and
    ``by_wrapper``: whether it would be another without the wrapper.

    Each page is matched against the wrapper of its host (:func:`infer_wrappers`). Left out are heads, scripts, styles, menus, page headers,
    footers, sidebars, forms and comments of readers, by their tags and words; notices, adverts and the like, by words that the wrapper must bear out
    (:func:`main_text`); boxes with the template's own text; and all outside of the content. A page that the wrapper gives no text for is
    read by its own article or main elements, or as a whole.
    Tags may be left open, pages cut off. A null or empty page gives an empty text. Repeated pages stay. Columns named text or by_wrapper in
    ``pages`` are replaced, all others pass through. An empty table gives an empty one.

    Wrappers of all hosts are sent to all executors where they are small, and no page is shuffled; else pages meet them by host, hot hosts dealt
    to several tasks.
    """
    kept = [c for c in pages.columns if c not in ("text", "by_wrapper")]
    wrappers = materialize(infer_wrappers(pages, url, html).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"), F.col("n_pages").alias("__n")))
    keyed = pages.select(*kept, host_of(url).alias("__host"))
    size = wrappers.agg(F.sum(F.octet_length("__wrapper") + F.octet_length("__host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(wrappers), "__host", "left")
    else:
        joined = join_counted(keyed, wrappers, ["__host"], "__n", html, "left")
    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept], "text string, by_wrapper boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {}
        for batch in slices(batches, kept.index(html)):
            rows = []
            for page, packed in zip(batch.column(kept.index(html)).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                if packed not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[packed] = Wrapper.unpacked(packed)
                rows.append(main_text(page, known[packed]))
            texts, by = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(by, pa.bool_())], names=[*kept, "text", "by_wrapper"])

    return joined.select(*kept, "__wrapper").mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_wrapper")
