"""Main text of web pages by minimum-cut labelling (operator 12).

A page becomes blocks: runs of text between the edges of block elements, each with the
path of elements it stands in. A classifier gives each block the cost of calling it content and
that of calling it boilerplate, the capacities of its edges to the two terminals. Blocks that
follow each other, and blocks that follow each other under one parent, are joined by
smoothness edges whose capacity falls with their distance in the document tree. The minimum
cut, found by maximum flow, separates content from boilerplate.

The classifier adds the log-odds of two things. Markup says what a part of the page is for
(``nav``, ``footer``, class names...): fixed weights below. Shape (length, share of links,
punctuation...) is weighed by a logistic regression that is trained here, on a bounded sample
of pages, with the blocks whose markup decides as labels; without any it keeps its prior.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricslake.llm.common import lean

#: Bound of the training sample: pages, and blocks of a page (evenly spaced).
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 64
#: Log-odds of a block inside markup for content, or for something else.
CONTENT_HINT, OTHER_HINT = 3.0, -8.0
#: Shape counts for at most so much.
SHAPE_LIMIT = 4.0
#: Capacity between neighbours under one parent, and its factor for each step between others.
SMOOTH, DECAY = 2.0, 0.5

# Elements of HTML by how their text is treated.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rt ruby s samp small span strike "
    "strong sub sup time tt u var td th picture".split()
)
UNSEEN = frozenset("head script style template svg math canvas object audio video map select button datalist".split())
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Words of class names, ids and roles.
OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs complementary contentinfo comment comments consent cookie cookies "
    "copyright disclaimer discussion disqus dropdown footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification notifications pager pagination popup promo promoted promotion related replies reply respond search share sharing "
    "sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Beginnings and ends of longer words of the same kind.
OTHER_STEM = re.compile(r"(?:advert|breadcrumb|commentform|commentlist|cookie|newsletter|paginat|sidebar|sponsor|subscri).*|.+(?:banner|comments|footer|header|menu|nav|sidebar)")
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
#: A new element of the first kind ends an open one of the second, up to a limit of scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)|([^\s=/"']+)""")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """An open element, or one that a block stands in."""

    __slots__ = ("tag", "parent", "depth", "inline", "content", "other", "strong", "header", "unseen", "chars", "main")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.inline = tag in INLINE
        words, roles, self.unseen = set(), set(), tag in UNSEEN
        for name, value, bare in ATTR.findall(attrs) if attrs and tag not in ("html", "body") else ():
            name = (name or bare).lower()
            value = html.unescape(value.strip("\"'")) if value else ""
            if name in ("class", "id", "itemprop"):
                words.update(WORD.findall(CAMEL.sub(" ", value).lower()))
            elif name == "role":
                roles.update(WORD.findall(value.lower()))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                self.unseen = True
        told = {w for w in words | roles if w in OTHER_WORDS or OTHER_STEM.fullmatch(w)}
        named = bool(told)
        self.content = (tag in CONTENT_TAGS or bool(roles & CONTENT_TAGS) or bool(words & CONTENT_WORDS)) and not named
        self.strong = (tag in CONTENT_TAGS or bool(roles & CONTENT_TAGS)) and not named
        self.other = (named or tag in OTHER_TAGS) and not self.strong
        self.header = self.other and (told == {"header"} or (tag == "header" and not told))
        if tag in ("td", "th") and (self.content or self.other):
            self.inline = False  # a cell of a layout
        self.chars, self.main = 0, False


class Block(NamedTuple):
    """A run of text; ``box`` is the innermost block element around it."""

    text: str
    box: Element
    links: int  # characters inside links


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page, in its order. Scripts, styles and unseen parts are left out."""
    page = page or ""
    top = Element("", None, "")
    here, out = top, []
    pieces: list[str] = []
    linked: list[str] = []

    def flush(box):
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, box, min(len(text), len("".join("".join(linked).split())))))
        pieces.clear()
        linked.clear()

    def box_of(element):
        while element.inline:
            element = element.parent
        return element

    def close_to(element):
        nonlocal here
        while here is not element:
            if not here.inline:
                flush(box_of(here))
            here = here.parent

    def say(raw):
        text, step = html.unescape(raw), here
        pieces.append(text)
        while step.inline and step.tag != "a":
            step = step.parent
        if step.tag == "a":
            linked.append(text)

    def unseen(element):
        while element is not None:
            if element.unseen:
                return True
            element = element.parent
        return False

    hidden = False
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not hidden:
            say(page[at:lt])
        if lt == n:
            break
        match = TOKEN.match(page, lt)
        if match is None:
            nxt = page[lt + 1 : lt + 3]
            if not (nxt[:1].isalpha() or (nxt[:1] == "/" and nxt[1:].isalpha())):
                if not hidden:
                    say("<")  # a lone sign
                at = lt + 1
                continue
            end = page.find(">", lt)  # an open quote: the tag ends at the next sign
            if end < 0:
                break
            match = re.match(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>", page[lt : end + 1])
            at = end + 1
        else:
            at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            step = here
            while step is not top and step.tag != tag:
                step = step.parent
            if step is not top:
                close_to(step)
                if not step.inline:
                    flush(step)
                here = step.parent
                if tag in ("td", "th"):
                    pieces.append(" ")
            hidden = unseen(here)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                break
            at = page.find(">", end.end()) + 1 or n
            continue
        if tag in VOID:
            if tag == "hr":
                flush(box_of(here))
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag not in INLINE:
            step = here
            while step is not top and step.tag != "p" and (step.inline and step.tag not in ("td", "th")):
                step = step.parent
            if step.tag == "p":  # a paragraph ends where a block begins
                close_to(step)
                flush(step)
                here = step.parent
        if tag in CLOSES:
            ends, limits = CLOSES[tag]
            step, last = here, None
            while step is not top and step.tag not in limits:
                if step.tag in ends:
                    last = step
                step = step.parent
            if last is not None:
                close_to(last)
                if not last.inline:
                    flush(last)
                here = last.parent
        if tag in ("td", "th"):
            pieces.append(" ")
        if tag not in INLINE:
            flush(box_of(here))
        if match["attrs"].endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        here = Element(tag, here, match["attrs"])
        hidden = hidden or here.unseen
    close_to(top)
    flush(top)
    return out


def weigh(found: list[Block]) -> None:
    """Tell each element how much text it holds, and whether the main heading or part of the page."""
    for block in found:
        step, main = block.box, block.box.tag == "h1"
        while step is not None:
            step.chars += len(block.text)
            step.main |= main
            main |= step.strong
            step = step.parent


def hint(block: Block, total: int) -> float:
    """Log-odds from markup. What stands in something other is other, unless that wraps the page
    (it holds its main part and most of its text) or the block is the heading in a header of the main part."""
    step, inner = block.box, 0.0
    while step is not None:
        if step.other:
            wraps = step.main and 2 * step.chars > total and step.tag not in ("nav", "footer", "aside")
            if not wraps and not (step.header and block.box.tag in ("h1", "h2") and _inside(step.parent)):
                return OTHER_HINT
        elif step.content and not inner:
            inner = CONTENT_HINT
        step = step.parent
    return inner


def _inside(element: Element | None) -> bool:
    while element is not None:
        if element.content:
            return True
        element = element.parent
    return False


SHAPES = ("one", "length", "links", "stops", "heading", "item", "legal")
#: Weights before training: long running text is content, links and legal lines are not.
PRIOR = np.array([-1.5, 0.9, -5.0, 0.8, 1.0, -0.8, -3.0])
#: Precision of the prior, steps of training.
PRIOR_STRENGTH, STEPS = 20.0, 25
LEGAL = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|cookie|javascript", re.IGNORECASE)


def shape(block: Block) -> list[float]:
    text, tag = block.text, block.box.tag
    stops = sum(map(text.count, ".,;:!?。，"))
    return [
        1.0,
        float(np.log1p(len(text)) / 2),
        block.links / len(text),
        min(1.0, stops / 3),
        float(tag in ("h1", "h2", "h3", "h4", "blockquote", "pre", "figcaption")),
        float(tag in ("li", "dd", "dt", "td", "tr", "option")),
        float(len(text) < 300 and LEGAL.search(text) is not None),
    ]


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression around the prior, both classes of equal weight, by Newton steps."""
    w = PRIOR.copy()
    if not len(y) or y.all() or not y.any():
        return w
    each = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * len(y)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + PRIOR_STRENGTH * (w - PRIOR)
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def distance(a: Element, b: Element) -> int:
    """Steps between two elements by way of their lowest common ancestor."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one, and with the next one that hangs on the same element."""
    last: dict[int, int] = {}
    for k, block in enumerate(found):
        hung = block.box.parent or block.box
        if k:
            other = found[k - 1].box
            apart = distance(block.box, other)
            siblings = apart == 2 and other.parent is block.box.parent
            yield k - 1, k, SMOOTH if siblings or not apart else SMOOTH * DECAY**apart
        before = last.get(id(hung))
        if before is not None and before != k - 1:
            yield before, k, SMOOTH * DECAY
        last[id(hung)] = k


def min_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the side of the source in a minimum cut (the smallest such side).

    A positive ``unary`` is the capacity from the source, a negative one that to the sink; a pair has its
    capacity both ways. A node whose terminal holds more than all its edges stays with it in every
    minimum cut: such nodes are cut off first, which leaves short paths. Dinic's maximum flow labels the rest.
    """
    n = len(unary)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, capacity in pairs:
        near[a].append((b, capacity))
        near[b].append((a, capacity))
    excess, room = list(unary), [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if side[k] is not None or abs(excess[k]) <= room[k] + 1e-12:
            continue
        side[k] = excess[k] > 0
        for other, capacity in near[k]:
            if side[other] is None:
                excess[other] += capacity if side[k] else -capacity
                room[other] -= capacity
                waiting.append(other)

    rest = [k for k in range(n) if side[k] is None]
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a, b, there, back):
        arcs[a].append(len(to))
        to.append(b)
        left.append(there)
        arcs[b].append(len(to))
        to.append(a)
        left.append(back)

    for k in rest:
        if excess[k] > 0:
            arc(source, k, excess[k], 0.0)
        elif excess[k] < 0:
            arc(k, sink, -excess[k], 0.0)
        for other, capacity in near[k]:
            if side[other] is None and k < other:
                arc(k, other, capacity, capacity)

    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if left[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            break
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # a blocking flow, one path after the other
            if a == sink:
                amount = min(left[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    left[e] -= amount
                    left[e ^ 1] += amount
                    if left[e] <= 1e-12 and not cut:
                        cut = k + 1
                path = path[: cut - 1] if cut else []
                a = to[path[-1]] if path else source
                continue
            while place[a] < len(arcs[a]):
                e = arcs[a][place[a]]
                if left[e] > 1e-12 and level.get(to[e]) == level[a] + 1:
                    break
                place[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                continue
            path.append(arcs[a][place[a]])
            a = to[path[-1]]
    return [k in level if side[k] is None else bool(side[k]) for k in range(n)]


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    if not found:
        return []
    weigh(found)
    total = sum(len(b.text) for b in found)
    shapes = np.clip(np.array([shape(b) for b in found]) @ weights, -SHAPE_LIMIT, SHAPE_LIMIT)
    return min_cut([hint(b, total) + s for b, s in zip(found, shapes.tolist())], list(edges(found)))


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found, weights)) if keep)


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> np.ndarray:
    """Weights of the shapes, from at most SAMPLE_PAGES pages drawn by a hash of their id and html and
    SAMPLE_BLOCKS blocks of each; only those blocks' shapes reach the driver."""
    rows = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.lit(12), F.col(id_col).cast("string"), html_col).alias("pick"))
    n = max(1, rows.count())
    place = F.pmod("pick", F.lit(1 << 52)) / F.lit(float(1 << 52))
    sample = rows.filter(place <= min(1.0, 0.8 * SAMPLE_PAGES / n)).select("html").limit(SAMPLE_PAGES)

    def run(batches):
        for batch in batches:
            out: list[list[float]] = []
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                weigh(found)
                total = sum(len(b.text) for b in found)
                told = [(b, hint(b, total)) for b in found]
                told = [(b, h) for b, h in told if h]
                for k in range(0, len(told), -(-len(told) // SAMPLE_BLOCKS) or 1):
                    out.append([*shape(told[k][0]), float(told[k][1] > 0)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["row"])

    told = sample.mapInArrow(lean(run), "row array<double>").collect()
    if not told:
        return PRIOR.copy()
    rows_ = np.array(sorted(r["row"] for r in told))
    return train(rows_[:, :-1], rows_[:, -1] > 0)


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every whole page.

    Returns one row for each row of ``pages``: ``id_col``, ``url_col``, ``text`` (content blocks in
    page order, one a line; empty if there is none) and ``n_chars`` (its code points). A null or empty
    html has an empty text; rows that repeat each other or have no id are kept; other columns are not read.
    ``weights`` are those of ``fit`` over the same pages by default.
    """
    weights = fit(pages, html_col, id_col) if weights is None else weights
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    return pages.select(id_col, url_col, html_col).mapInArrow(lean(run), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
