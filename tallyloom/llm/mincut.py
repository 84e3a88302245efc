"""Main text of web pages by a minimum cut.

A page becomes text blocks. What a classifier makes of a block are the capacities to
the two terminals; blocks that are neighbours or near each other in the tree of
elements are joined by edges. The minimum cut separates content from the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, drawn, table, texts

OPENS = re.compile(r"<(?:!--|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?])")
STOPS = re.compile("[>\"']")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button legend".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the second names.
CLOSES = {"p": ({"p"}, {"div", "td", "th", "li", "article", "section", "body"}), "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
P_ENDS = BLOCK - {"body", "html", "head", "option", "legend", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}
# What an element around a block says of it: log odds by tag, else by a word of its class, id or role.
OUTSIDE = frozenset("nav footer aside form button select menu dialog head fieldset".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs"
    " share sharing social related recommended comment comments reply replies disqus footer header masthead newsletter subscribe login search widget toolbar pagination".split()
)
INSIDE = frozenset(("article", "main"))
INSIDE_NAMES = frozenset("article content main post story entry".split())
BY_TAG, BY_NAME, FADES = 4.0, 3.0, 0.5


@dataclass
class Element:
    """An open element: what stands around it, its nearest block element, and its markers' log odds, of which outer ones fade."""

    tag: str
    number: int
    parent: int
    depth: int
    block: str
    odds: float
    within: bool


@dataclass
class Block:
    text: str
    tag: str
    element: int
    odds: float
    link_chars: int


class Page:
    """The text blocks of a page in order, and for each element its parent and depth."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parents, self.depths = [-1], [0]
        self.stack = [Element("", 0, -1, 0, "", 0.0, False)]
        self.open: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.page = page
        self.ends: dict[int, int] = {}
        self.read()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                top = self.stack[-1]
                chars = len(" ".join(html.unescape(" ".join(self.linked)).split())) if self.linked else 0
                self.blocks.append(Block(text, top.block, top.number, top.odds, chars))
            self.parts, self.linked = [], []

    def close(self, names, until=()) -> None:
        """End the innermost open element of these names, with all that is open in it, unless one of the others is nearer."""
        last = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)
        at = last(names)
        if at > 0 and at > last(until):
            for e in self.stack[at:]:
                self.open[e.tag].pop()
            del self.stack[at:]

    def tag_end(self, at: int) -> int:
        """Where a tag's > stands, quoted ones passed over; where quotes don't close, the next one. Places met are remembered, so a page is read once."""
        met, i, end = [], at, -1
        while True:
            if i in self.ends:
                end = self.ends[i]
                break
            met.append(i)
            if not (m := STOPS.search(self.page, i)):
                break
            if m[0] == ">":
                end = m.start()
                break
            if (i := self.page.find(m[0], m.end()) + 1) == 0:
                break
        self.ends.update(dict.fromkeys(met, end))
        return end if end >= 0 else self.page.find(">", at)

    def text(self, piece: str) -> None:
        if piece:
            self.parts.append(piece)
            if self.open.get("a"):
                self.linked.append(piece)

    def read(self) -> None:
        page, at = self.page, 0
        while m := OPENS.search(page, at):
            self.text(page[at : m.start()])
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                at = end + 3 if end >= 0 else len(page)
                continue
            end = self.tag_end(m.end()) if m[2] else page.find(">", m.end())
            if end < 0:
                self.text(page[m.start() :])
                at = len(page)
                break
            at = end + 1
            if m[2]:
                at = self.tag(m[2].lower(), bool(m[1]), page[m.end() : end], at)
        self.text(page[at:])
        self.flush()

    def tag(self, tag: str, closes: bool, attributes: str, at: int) -> int:
        """Deal with a tag that ends before `at`; where to read on."""
        if tag in BLOCK or tag == "xmp":
            self.flush()
        if closes and tag != "br":
            self.close((tag,))
            return at
        if tag == "br":
            self.text(" ")
            return at
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "math")):
            return at
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(self.page, at)
            if tag == "xmp":  # shown as it is
                self.text(html.escape(self.page[at : end.start() if end else None], quote=False))
                self.flush()
            return end.end() if end else len(self.page)
        if tag in P_ENDS:
            self.close(("p",), ("td", "th", "article", "section", "body", "button"))
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        names = {n for a in NAMED.finditer(attributes) for n in PARTS.findall((a[1] or a[2] or a[3] or "").lower())}
        top = self.stack[-1]
        sign = 0.0
        if tag in INSIDE:
            sign = BY_TAG
        elif tag in OUTSIDE or (tag == "header" and not top.within):
            sign = -BY_TAG
        elif tag not in ("body", "html") and names & OUTSIDE_NAMES:
            sign = -BY_NAME
        elif names & INSIDE_NAMES:
            sign = BY_NAME
        number = len(self.parents)
        self.parents.append(top.number)
        self.depths.append(top.depth + 1)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, number, top.number, top.depth + 1, tag if tag in BLOCK else top.block, sign + FADES * top.odds if sign else top.odds, top.within or sign > 0))
        return at

    def apart(self, a: int, b: int, most: int = 12) -> int:
        """Steps between two elements in the tree, up to `most`."""
        steps = 0
        while a != b and steps < most:
            if self.depths[a] < self.depths[b]:
                a, b = b, a
            a, steps = self.parents[a], steps + 1
        return steps


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: maximal text between tags of block elements, references decoded, one space for white space."""
    return Page(page).blocks


FEATURES = 7


def features(b: Block) -> list[float]:
    n = max(1, len(b.text))
    stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
    return [1.0, math.log1p(n) / 5, min(1.0, b.link_chars / n), min(1.0, 20 * stops / n), float(b.tag == "p"), float(b.tag in ("h1", "h2", "h3")), float(b.tag == "li")]


@dataclass(frozen=True)
class Labeller:
    """weights: of a logistic classifier of a block's text; most: its least and greatest log odds; the rest are the strengths of the edges.

    Neither the text nor the elements around a block decide alone: the nearest marker gives at most
    BY_TAG, what stands farther out a fading share, the text `most`, and a block's edges
    together more than the weaker of these.
    """

    weights: np.ndarray = field(default_factory=lambda: np.array([-0.5, 1.0, -3.0, 0.5, 0.5, 0.5, -1.0]))
    most: float = 2.5
    beside: float = 1.6
    near: float = 0.8

    def capacities(self, blocks: list[Block]) -> list[float]:
        """Log odds of content: the classifier's, within limits, plus what the elements around the block say."""
        x = np.array([features(b) for b in blocks]) @ self.weights
        return [float(np.clip(v, -self.most, self.most)) + b.odds for v, b in zip(x, blocks, strict=True)]

    def edges(self, page: Page) -> list[tuple[int, int, float]]:
        """Neighbours, the closer in the tree the stronger; and each block to the last one before it with the same parent."""
        out, last = [], {}
        for i, b in enumerate(page.blocks):
            if i:
                out.append((i - 1, i, self.beside / (1 + 0.5 * page.apart(page.blocks[i - 1].element, b.element))))
            parent = page.parents[b.element]
            if (j := last.get(parent)) is not None and j != i - 1:
                out.append((j, i, self.near))
            last[parent] = i
        return out

    def content(self, page: str | None) -> list[Block]:
        read = Page(page) if page else None
        if read is None or not read.blocks:
            return []
        keep = minimum_cut(self.capacities(read.blocks), self.edges(read))
        return [b for b, k in zip(read.blocks, keep, strict=True) if k]


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is on the source side of a minimum cut.

    A node of odds x has capacity x from the source if x > 0, -x to the sink if not.
    Where a terminal outweighs all edges of a node the label is certain; such nodes
    are folded into their neighbours' terminals first, and blocking flows settle those that remain.
    """
    n = len(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    odds, label = list(odds), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) > sum(around[i].values()):
            label[i] = odds[i] > 0
            for j, w in around[i].items():
                if label[j] is None:
                    odds[j] += w if label[i] else -w
                    del around[j][i]
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: {j: w for j, w in around[i].items() if label[j] is None} for i in rest}
        room[source], room[sink] = {}, {}
        for i in rest:
            if odds[i] > 0:
                room[source][i], room[i][source] = odds[i], 0.0
            elif odds[i] < 0:
                room[i][sink], room[sink][i] = -odds[i], 0.0
        while sink in (level := levels(room, source)):
            push(room, level, source, sink)
        for i in rest:
            label[i] = i in level
    return [bool(x) for x in label]


def levels(room: dict[int, dict[int, float]], source: int) -> dict[int, int]:
    """Steps from the source to all that it still reaches."""
    level, todo = {source: 0}, deque([source])
    while todo:
        u = todo.popleft()
        for v, c in room[u].items():
            if c > 1e-9 and v not in level:
                level[v] = level[u] + 1
                todo.append(v)
    return level


def push(room: dict[int, dict[int, float]], level: dict[int, int], source: int, sink: int) -> None:
    """A blocking flow: augment along paths that rise by one level until none is left; an edge that led nowhere isn't tried again."""
    arcs, at = {u: list(room[u]) for u in level}, dict.fromkeys(level, 0)
    way = [source]
    while way:
        u = way[-1]
        if u == sink:
            least = min(room[x][y] for x, y in pairwise(way))
            for x, y in pairwise(way):
                room[x][y] -= least
                room[y][x] = room[y].get(x, 0.0) + least
            way = [source]
            continue
        while at[u] < len(arcs[u]) and not (room[u][v := arcs[u][at[u]]] > 1e-9 and level.get(v) == level[u] + 1):
            at[u] += 1
        if at[u] < len(arcs[u]):
            way.append(v)
        else:
            way.pop()
            if way:
                at[way[-1]] += 1


def fit(pages: DataFrame, *, html: str = "html", sample_rows: int = 1000, chars: int = 1 << 18) -> Labeller:
    """The classifier, fitted on at most `sample_rows` pages, of long ones a stretch of `chars` characters.

    Its labels come from the pages: blocks whose nearest markers say content or not teach, other
    blocks teach nothing. Without labelled blocks the given weights stay.
    """
    x, y = [], []
    for r in drawn(pages, html, sample_rows, chars=chars):
        for b in blocks_of(r.t):
            if abs(b.odds) >= 0.8 * BY_NAME:
                x.append(features(b))
                y.append(float(b.odds > 0))
    out = Labeller()
    if not x or len(set(y)) < 2:
        return out
    x, y, w = np.array(x), np.array(y), out.weights.copy()
    for _ in range(25):  # Newton's method, lightly penalised
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-2 * np.eye(FEATURES), x.T @ (p - y) / len(x) + 1e-2 * w)
    return Labeller(weights=w)


def extract(pages: DataFrame, labeller: Labeller, *, html: str = "html") -> DataFrame:
    """Add text (content blocks in page order, parted by two line feeds) and n_chars (its code points).

    A null or empty page, or one without content, gives an empty text. Pages are
    read whole. Repeated rows give repeated results; columns of the new names are
    replaced, others stay.
    """

    def make():
        def work(batch):
            found = ["\n\n".join(b.text for b in labeller.content(t)) for t in texts(batch, html)]
            return [found, [len(t) for t in found]]

        return work

    return arrow_map(pages, [("text", "string"), ("n_chars", "long")], make, rows=256)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, fit(pages)).drop("html")
