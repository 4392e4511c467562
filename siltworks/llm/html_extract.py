"""Main text of web pages by minimum cut.

A page is a row of text blocks. A logistic classifier looks at the text of a block and at the text it stands among, never
at names; element and class names are evidence of their own. The sum of both is the cost of either label and becomes the
capacity to one of the two terminals; blocks next to each other in the page, and neighbours below the same DOM parent, are
tied by smoothness edges. The maximum flow separates content from the rest, so text and neighbours can overrule a name, and
pages without telling names are cut by their texts. The classifier is fitted on a bounded sample of pages, with the blocks
that a name tells about as examples, and stays near its prior elsewhere.

What names say: a part that is left out by its name stays out with all in it, whatever the names inside, unless one part
named as content holds more than half of the page's text outside links. Names of the page as a whole say nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import map_rows, octets, text_of

# The sample of pages that training reads: so many, of so many bytes in all and each.
SAMPLE_PAGES, SAMPLE_BYTES, PAGE_BYTES = 200, 8 * 1024 * 1024, 128 * 1024
NEXT_EDGE, PARENT_EDGE = 0.6, 0.4
# Evidence in the classifier's log odds: inside content, left out, beside the page's one main part, and a page's fine print where
# no name says that it is content; of at most so many characters.
SAYS_MAIN, SAYS_OFF, BESIDE_MAIN, SAYS_PRINT, PRINT_CHARS = 1.2, -4.5, -1.5, -6.0, 300

# What stands in these is left out up to their end tag; without one, to the end of the page only where it is raw text.
SKIPPED = frozenset("script style noscript template iframe object svg math title textarea select canvas audio video".split())
RAW = frozenset("script style noscript iframe title textarea".split())
# Any other start tag, and text, closes a head that has no end tag.
IN_HEAD = SKIPPED | frozenset("base basefont bgsound link meta noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OFF_TAGS = frozenset("nav footer aside form menu dialog button label fieldset option header".split())
MAIN_TAGS = frozenset("article main".split())
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr nav navbar navigation menu"
    " sidebar aside footer header masthead breadcrumb breadcrumbs share sharing social related recommended comment comments commentlist reply replies respond disqus newsletter"
    " subscribe subscription signup login popup modal overlay dialog widget toolbar pagination pager copyright legal search searchbox form contentinfo complementary skip".split()
)
MAIN_WORDS = frozenset("article articlebody content post entry story main body text".split())

# Lists and tables stand for what holds them.
FRAMES = frozenset("ul ol dl table thead tbody tfoot tr".split())
# A class such as ``with-sidebar`` tells what a page has, not what an element is.
HAS_WORDS = frozenset("with has no without hide show".split())
# Phrases of a page's fine print.
_PRINT = re.compile(r"\s*(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|[12]\d{3}\b))|\ball rights reserved\b", re.I)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*")
# A slash at the end of a start tag, but not of an unquoted value.
_CLOSED = re.compile(r"(?:\A|[\s\"'])/\s*\Z")


@dataclass
class Block:
    """Text with single blanks, characters inside links, tag, parent element and the innermost element that holds it.

    ``place`` is what names say (1 main, -1 not, 0 nothing), ``beside`` whether it stands outside the page's one main part, and
    ``kin`` how much text stands in its parent or the parent's parent, as a share of what the richest element has.
    """

    text: str
    linked: int
    tag: str
    parent: int
    holder: int
    place: int = 0
    beside: bool = False
    kin: float = 0.0


@dataclass
class _Element:
    tag: str
    number: int
    outer: int
    says: int


def _says(tag: str, attributes: str) -> int:
    """What an element's own names say: 1 main, -1 not, 0 nothing."""
    if tag in ("html", "body"):
        return 0
    said = set()
    if attributes:
        for m in _NAMES.finditer(attributes):
            for name in m[1].strip("\"'").split():
                found = [w.lower() for w in _WORDS.findall(name)]
                if found and found[0] not in HAS_WORDS:
                    said.update(found)
    off, main = bool(said & OFF_WORDS), bool(said & MAIN_WORDS)
    if tag in OFF_TAGS or off and (tag in MAIN_TAGS or not main):
        return -1
    return int(tag in MAIN_TAGS or main and not off)


def _settle(found: list[Block], elements: list[_Element]) -> None:
    """Sets ``place``, ``beside`` and ``kin`` of each block, which need the whole page."""

    def parents(b: Block) -> list[int]:
        i = b.parent
        while elements[i].tag in FRAMES:
            i = elements[i].outer
        above = elements[i].outer
        return [i] if elements[above].tag in ("", "html", "body") else [i, above]

    plain = [0] * len(elements)
    points = [0.0] * len(elements)
    for b in found:
        n = len(b.text) - b.linked
        plain[b.holder] += n
        for share, i in enumerate(parents(b), 1):
            points[i] += n / share
    for e in reversed(elements[1:]):
        plain[e.outer] += plain[e.number]
    named = [e.number for e in elements if e.says > 0]
    best = max(named, key=lambda i: (plain[i], -i), default=0)
    if 2 * plain[best] <= plain[0]:
        best = 0
    place, inside = [0] * len(elements), [False] * len(elements)
    for e in elements[1:]:
        i, outer = e.number, place[e.outer]
        inside[i] = i == best or inside[e.outer]
        # A header inside the main part belongs to it.
        says = 0 if e.tag == "header" and outer > 0 else e.says
        place[i] = 1 if i == best else outer if outer < 0 or not says else says
    richest = max(points)
    for b in found:
        b.place, b.beside = place[b.holder], best > 0 and not inside[b.holder] and b.tag != "h1"
        b.kin = max(points[i] for i in parents(b)) / richest if richest else 0.0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order; scripts, styles, comments and markup left out, references decoded."""
    out: list[Block] = []
    stack = [_Element("", 0, 0, 0)]
    elements = stack[:]
    pieces: list[str] = []
    linked, links, at = 0, 0, 0
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            holder = next(e for e in reversed(stack) if e.tag not in INLINE)
            parent = next((e for e in reversed(stack[: stack.index(holder)])), stack[0])
            out.append(Block(text, linked, holder.tag, parent.number, stack[-1].number))
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            if stack[-1].tag == "head" and raw.strip():
                pop("head")
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            linked += len(text) if links else 0

    def pop(tag: str) -> None:
        nonlocal links
        while stack[-1].tag != tag:
            links -= stack.pop().tag == "a"
        links -= stack.pop().tag == "a"

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            close()
        if ending:
            if any(e.tag == tag for e in stack):
                pop(tag)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            pop("head")
        if tag in SKIPPED:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end or tag in RAW:
                at = end.end() if end else len(page)
            else:
                endless.add(tag)
        elif tag not in VOID and not _CLOSED.search(attributes):
            if tag in ENDS_P and any(e.tag == "p" for e in stack):
                pop("p")
            links += tag == "a"
            stack.append(_Element(tag, len(elements), stack[-1].number, _says(tag, attributes)))
            elements.append(stack[-1])
    add(page[at:])
    close()
    if out:
        _settle(out, elements)
    return out


FEATURES = ("one", "length", "linked", "sentence", "heading", "kin")
PRIOR = np.array([-2.0, 1.6, -4.0, 0.6, 1.0, 2.4])


def describe(block: Block) -> list[float]:
    """The classifier's features: the text of a block and the text it stands among."""
    n = len(block.text)
    return [
        1.0, min(1.0, math.log1p(n) / 6), min(1.0, block.linked / n), float(block.text[-1] in ".!?…"),
        float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), block.kin,
    ]


def evidence(block: Block) -> float:
    """What names, and the set phrases of fine print, add to the classifier's log odds."""
    if block.place > 0:
        return SAYS_MAIN + (BESIDE_MAIN if block.beside else 0.0)
    fine_print = len(block.text) < PRINT_CHARS and _PRINT.search(block.text)
    return (SAYS_OFF if block.place < 0 else 0.0) + (BESIDE_MAIN if block.beside else 0.0) + (SAYS_PRINT if fine_print else 0.0)


def fit(pages: list[str], prior: np.ndarray = PRIOR, tie: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic weights from blocks that names tell about, tied to the prior; no such blocks leave the prior."""
    found = [b for p in pages for b in blocks(p) if b.place]
    if not found:
        return prior.copy()
    x, y = np.array([describe(b) for b in found]), np.array([float(b.place > 0) for b in found])
    beta = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + tie * np.eye(len(beta)), x.T @ (y - p) / len(y) - tie * (beta - prior))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES, page_bytes: int = PAGE_BYTES) -> np.ndarray:
    """Weights from at most ``sample_pages`` pages of ``sample_bytes`` in all, in the order of a hash of the identifier.

    Pages longer than ``page_bytes``, null and empty ones are no examples, and a page that no longer fits is passed over.
    Without examples (an empty table, only such pages) the weights are the prior.
    """
    page = F.col(f"`{html_col}`")
    rows = pages.where(F.octet_length(page).between(1, page_bytes)).select(F.xxhash64(F.lit(5), F.col(f"`{id_col}`")).alias("o"), page.alias("h"))
    held, left = [], sample_bytes
    for r in rows.orderBy("o", F.xxhash64("h")).limit(sample_pages).collect():
        size = len(r["h"].encode())
        if size <= left:
            held.append(r["h"])
            left -= size
    return fit(held)


@dataclass
class Graph:
    """Terminal costs (above 0: content) and weighted edges between blocks."""

    costs: list[float]
    edges: dict[int, dict[int, float]] = field(default_factory=dict)

    def tie(self, a: int, b: int, weight: float) -> None:
        for x, y in ((a, b), (b, a)):
            own = self.edges.setdefault(x, {})
            own[y] = own.get(y, 0.0) + weight


def page_graph(found: list[Block], weights: np.ndarray) -> Graph:
    graph = Graph((np.array([describe(b) for b in found]) @ weights + np.array([evidence(b) for b in found])).tolist())
    last_below: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            graph.tie(i - 1, i, NEXT_EDGE if found[i - 1].place == b.place else NEXT_EDGE / 2)
        if b.parent in last_below:
            graph.tie(last_below[b.parent], i, PARENT_EDGE / (i - last_below[b.parent]))
        last_below[b.parent] = i
    return graph


def minimum_cut(graph: Graph) -> list[bool]:
    """The labelling (True: content) of least cost: cut terminals plus cut edges.

    A block whose terminal outweighs all its edges has that label in a least cut; it is settled first and its edges pass
    to the other blocks' terminals. What is left is separated by maximum flow along shortest paths.
    """
    costs, label = list(graph.costs), [None] * len(graph.costs)
    edges = {i: dict(e) for i, e in graph.edges.items()}
    todo = deque(range(len(costs)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(costs[i]) >= sum(edges.get(i, {}).values()):
            label[i] = costs[i] > 0
            for j, w in edges.pop(i, {}).items():
                costs[j] += w if label[i] else -w
                del edges[j][i]
                todo.append(j)
    open_ = [i for i, x in enumerate(label) if x is None]
    if open_:
        source, sink = -1, -2
        left: dict[int, dict[int, float]] = {source: {}, sink: {}}
        for i in open_:
            left[i] = dict(edges.get(i, {}))
        for i in open_:
            a, b, w = (source, i, costs[i]) if costs[i] > 0 else (i, sink, -costs[i])
            left[a][b] = w
            left[b].setdefault(a, 0.0)
        while True:
            before = {source: source}
            queue = deque([source])
            while queue and sink not in before:
                a = queue.popleft()
                for b, w in left[a].items():
                    if w > 1e-12 and b not in before:
                        before[b] = a
                        queue.append(b)
            if sink not in before:
                break
            path, b = [], sink
            while b != source:
                path.append((before[b], b))
                b = before[b]
            push = min(left[a][b] for a, b in path)
            for a, b in path:
                left[a][b] -= push
                left[b][a] = left[b].get(a, 0.0) + push
        for i in open_:
            label[i] = i in before
    return label


def main_text(page: str, weights: np.ndarray) -> tuple[str, int, int]:
    """The main text of a page, its blocks and its content blocks."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    kept = [b.text for b, content in zip(found, minimum_cut(page_graph(found, weights))) if content]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, weights: np.ndarray, keys: list[str], html_col: str = "html") -> DataFrame:
    """``keys`` of each row with text, n_blocks and n_content; null and empty pages give an empty text.

    Whole pages are read, repeated rows alike, other columns not at all. ``keys`` must not be called like the results.
    """
    rows = pages.select(*[F.col(f"`{k}`") for k in keys], text_of(html_col).alias("_h"))
    width, held = len(keys), weights.tolist()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = np.array(held)
        for batch in batches:
            carried = zip(*[batch.column(i).to_pylist() for i in range(width)]) if width else iter([()] * batch.num_rows)
            for key, page in zip(carried, octets(batch.column(width))):
                yield *key, *main_text(page.decode("utf-8", "replace"), own)

    return map_rows(rows, run, (kinds + ", " if kinds else "") + "text string, n_blocks int, n_content int")
