"""Small DOM trees of HTML pages, and their alignment by simple tree matching."""

from __future__ import annotations

import html
import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+|\"[^\"]*+\"?|'[^']*+'?")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript iframe template svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
#: A start tag ends these open elements, looked for no further out than the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


@dataclass
class Node:
    """A block element: tag and class words, children in order, and the numbers of its own texts."""

    tag: str
    words: frozenset[str] = frozenset()
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    texts: list[int] = field(default_factory=list)
    slot: int = 0

    @property
    def sign(self) -> tuple:
        return self.tag, self.words


@dataclass
class Page:
    root: Node
    texts: list[str]
    owners: list[Node]
    links: list[int]  # characters of each text inside links


#: Stands among an element's words if it is not shown.
HIDDEN = "#hidden"


def _class_words(attrs: str) -> frozenset[str]:
    """Words of the attributes class, id and role, and ``HIDDEN``. Other attributes, as ``data-id``, say nothing."""
    if not attrs or attrs.isspace():
        return frozenset()
    found, hidden = [], False
    for m in _ATTRIBUTE.finditer(attrs):
        name = (m[1] or "").lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            found += re.split("[^a-z]+", value.lower())
        elif name == "hidden":
            hidden = value.lower() != "until-found"
        elif name == "style" and "display" in value.lower():
            hidden = hidden or "display:none" in _SPACE.sub("", value.lower())
    return frozenset([w for w in found if w] + [HIDDEN] * hidden)


def parse(source: str | None) -> Page:
    """The blocks of a page. Character references are decoded, white space in a block is one space."""
    source = source or ""
    page = Page(Node("#page"), [], [], [])
    node, open_tags, line, linked, in_link = page.root, [], [], 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            node.texts.append(len(page.texts))
            page.texts.append(text)
            page.owners.append(node)
            page.links.append(linked)
        line.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal node, in_link
        while len(open_tags) > depth:
            tag = open_tags.pop()
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag not in INLINE:
                flush()
                node = node.parent or page.root

    def last_open(tags: set[str], within: set[str]) -> int | None:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i] in tags:
                return i
            if open_tags[i] in within:
                return None
        return None

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        chunk = source[at : found.start() if found else size]
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            line.append(chunk)
            linked += len(chunk) * (in_link > 0)
        if not found:
            break
        at = found.end()
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            if tag in open_tags:
                close_to(len(open_tags) - 1 - open_tags[::-1].index(tag))
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                line.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            line.append(" ")
            if not found["attrs"].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            continue
        if tag not in INLINE:
            flush()
            i = last_open({"p"}, {"button", "td", "th", "table"})
            if i is not None:
                close_to(i)
            if tag in CLOSES:
                i = last_open(*CLOSES[tag])
                while i is not None:
                    close_to(i)
                    i = last_open(*CLOSES[tag])
            child = Node(tag, _class_words(found["attrs"]), node)
            node.children.append(child)
            node = child
        elif tag == "a":
            in_link += 1
        open_tags.append(tag)
    flush()
    return page


@dataclass
class Kinds:
    """The different subtrees of a page, numbered so that what is below one has lower numbers."""

    signs: list[tuple] = field(default_factory=list)
    below: list[tuple[int, ...]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    numbers: dict[tuple, int] = field(default_factory=dict)

    def number(self, sign: tuple, below: tuple[int, ...]) -> int:
        kind = self.numbers.setdefault((sign, below), len(self.signs))
        if kind == len(self.signs):
            self.signs.append(sign)
            self.below.append(below)
            self.sizes.append(1 + sum(self.sizes[k] for k in below))
        return kind


@dataclass
class Shape:
    """A tree for matching: runs of siblings whose whole subtrees are alike count as one."""

    sign: tuple
    nodes: list[Node]
    children: list[Shape]
    kind: int
    kinds: Kinds
    slot: int = 0

    @property
    def size(self) -> int:
        return self.kinds.sizes[self.kind]


def _fold(one: Shape, other: Shape) -> None:
    """Takes the nodes of a shape into another of its kind."""
    todo = [(one, other)]
    while todo:
        a, b = todo.pop()
        a.nodes += b.nodes
        todo += zip(a.children, b.children, strict=True)


def shape_of(page: Page) -> Shape:
    """The page's shape, with slots numbered from 1 in page order."""
    order, todo = [], [page.root]
    while todo:
        order.append(todo.pop())
        todo += order[-1].children
    kinds = Kinds()
    made: dict[int, Shape] = {}
    for node in reversed(order):
        children: list[Shape] = []
        for child in node.children:
            shape = made.pop(id(child))
            if children and children[-1].kind == shape.kind:
                _fold(children[-1], shape)
            else:
                children.append(shape)
        sign = node.sign
        made[id(node)] = Shape(sign, [node], children, kinds.number(sign, tuple(c.kind for c in children)), kinds)
    root = made[id(page.root)]
    count, todo = 0, [root]
    while todo:
        shape = todo.pop()
        count += 1
        shape.slot = count
        todo += reversed(shape.children)
    return root


#: Rows of a table that are kept at once; others are made again from those when asked for.
KEPT_ROWS = 64


class Matching:
    """Simple tree matching between the kinds of two pages.

    Scores are kept by pair of kinds, four bytes each, however many elements are of a kind. Siblings that
    are alike from either end are paired at once, which no pairing betters. A table over the rest is held in
    ``KEPT_ROWS`` rows a level.
    """

    def __init__(self, one: Kinds, other: Kinds) -> None:
        self.one, self.other = one, other
        self.same: list[int] = []  # the other page's number of each kind, or -1
        for sign, below in zip(one.signs, one.below, strict=True):
            self.same.append(other.numbers.get((sign, tuple(self.same[k] for k in below)), -1))
        self.scores: dict[int, array] = {}

    def _plain(self, a: int, b: int) -> int | None:
        """A score that needs no table, or one that is known."""
        if self.one.signs[a] != self.other.signs[b]:
            return 0
        if self.same[a] == b:
            return self.one.sizes[a]
        if not self.one.below[a] or not self.other.below[b]:
            return 1
        known = self.scores.get(a)
        return None if known is None or known[b] < 0 else known[b]

    def _ends(self, a: int, b: int) -> tuple[int, int]:
        """How many siblings are alike from the first and from the last."""
        ones, others = self.one.below[a], self.other.below[b]
        first, last, most = 0, 0, min(len(ones), len(others))
        while first < most and self.same[ones[first]] == others[first]:
            first += 1
        while last < most - first and self.same[ones[-1 - last]] == others[-1 - last]:
            last += 1
        return first, last

    def _rest(self, a: int, b: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        first, last = self._ends(a, b)
        ones, others = self.one.below[a], self.other.below[b]
        return first, last, ones[first : len(ones) - last], others[first : len(others) - last]

    def score(self, a: int, b: int) -> int:
        """The most nodes that two trees map in order; what is below is scored first, from a stack."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._plain(x, y) is not None:
                todo.pop()
                continue
            first, last, ones, others = self._rest(x, y)
            some = set(others)
            missing = [(k, m) for k in set(ones) for m in some if self._plain(k, m) is None]
            if missing:
                todo += missing
                continue
            todo.pop()
            alike = self.one.below[x][:first] + self.one.below[x][len(self.one.below[x]) - last :]
            total = 1 + sum(self.one.sizes[k] for k in alike)
            if ones and others:
                total += int(_Table(self, ones, others).last()[-1])
            if x not in self.scores:
                self.scores[x] = array("i", [-1]) * len(self.other.signs)
            self.scores[x][y] = total
        return self._plain(a, b)

    def pairs(self, a: int, b: int) -> dict[int, int]:
        """Which child of the one maps to which of the other, by place."""
        self.score(a, b)
        first, last, ones, others = self._rest(a, b)
        n, m = len(self.one.below[a]), len(self.other.below[b])
        found = {i: i for i in range(first)} | {n - 1 - i: m - 1 - i for i in range(last)}
        if ones and others:
            for k in set(ones):
                for j in set(others):
                    self.score(k, j)
            found |= {first + i: first + j for i, j in _Table(self, ones, others).pairs()}
        return found


class _Table:
    """The table of two rows of siblings, a numpy row at a time."""

    def __init__(self, matching: Matching, ones: tuple[int, ...], others: tuple[int, ...]) -> None:
        by_one, by_other = ({k: i for i, k in enumerate(dict.fromkeys(x))} for x in (ones, others))
        self.weights = np.array([[matching._plain(a, b) for b in by_other] for a in by_one], "i4")
        self.ones = [by_one[k] for k in ones]
        self.others = np.array([by_other[k] for k in others])

    def _next(self, before: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros_like(before)
        wide = len(before) - 1
        np.maximum(before[1:], before[:-1] + self.weights[self.ones[i]][self.others[:wide]], out=row[1:])
        return np.maximum.accumulate(row, out=row)

    def last(self) -> np.ndarray:
        row = np.zeros(len(self.others) + 1, "i4")
        for i in range(len(self.ones)):
            row = self._next(row, i)
        return row

    def pairs(self) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []

        def back(start: np.ndarray, low: int, high: int, j: int) -> int:
            """Goes back from row ``high`` to ``low``, whose row is ``start``; depth is log(rows)."""
            step = max(1, -(-(high - low) // KEPT_ROWS))
            row = start[: j + 1]
            kept = [row]
            for i in range(low, high):
                row = self._next(row, i)
                if (i + 1 - low) % step == 0 or i + 1 == high:
                    kept.append(row)
            if step > 1:
                for at in range(len(kept) - 2, -1, -1):
                    j = back(kept[at], low + at * step, min(high, low + (at + 1) * step), j) if j else 0
                return j
            i = high
            while i > low and j:
                now, before = kept[i - low], kept[i - low - 1]
                if now[j] == before[j]:
                    i -= 1
                elif now[j] == now[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((i, j))
            return j

        back(np.zeros(len(self.others) + 1, "i4"), 0, len(self.ones), len(self.others))
        return found


def match(one: Shape, other: Shape) -> int:
    """Simple tree matching: the most nodes that two trees with like roots map in order."""
    return Matching(one.kinds, other.kinds).score(one.kind, other.kind)


def align(page: Shape, template: Shape) -> None:
    """Gives each node of the page the slot of the template's node it maps to; nodes without one get
    a slot below zero from their place among unmatched elements."""
    matching = Matching(page.kinds, template.kinds)
    known: dict[tuple[int, int], dict[int, int]] = {}
    todo: list[tuple[Shape, Shape | None, int]] = [(page, template if page.sign == template.sign else None, 0)]
    while todo:
        a, b, above = todo.pop()
        if b is None:
            slot = -1 - zlib.crc32(repr((above, a.sign[0], sorted(a.sign[1]))).encode())
            pairs = {}
        else:
            slot = b.slot
            if a.children and b.children and (a.kind, b.kind) not in known:
                known[a.kind, b.kind] = matching.pairs(a.kind, b.kind)
            pairs = known.get((a.kind, b.kind), {})
        for node in a.nodes:
            node.slot = slot
        for k, child in enumerate(a.children):
            todo.append((child, b.children[pairs[k]] if k in pairs else None, slot))
