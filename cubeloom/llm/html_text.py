"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, each with
its place in the element tree.  Every block gets a score from a fitted linear
classifier (:data:`FEATURES`, :data:`WEIGHTS`; :mod:`cubeloom.llm.page_model` fits
them and a test repeats the fit).  Tags and class words of menus, adverts and the like count for all
that lies in their element, unless it wraps the text of the page itself; what lies outside the
page's ``article`` or ``main`` is the less likely content, whatever it is called.  The logistic costs of calling the block content
or boilerplate are its capacities to the two terminals.  Neighbouring blocks,
and consecutive blocks of one parent, are joined by smoothness edges whose
capacity follows their proximity in the tree.  The maximum flow gives the
labelling of least total cost; blocks on the source's side are the main text.

Text in elements that show none (scripts, styles, templates, form controls,
the head) makes no block.  Character references are decoded, white space
inside a block becomes one space, blocks are joined by one line feed.

One map over the pages: a page is one unit of work, nothing is shuffled, and
memory is that of a batch of pages.  Reading a page takes time in proportion to
its length, whatever its markup; blocks whose cost outweighs their edges are
decided before the flow, so that it runs over the doubtful ones only.

Defined cases: a null or empty page, and one without content, has an empty
text; broken markup is read leniently (unclosed and stray tags; from a tag whose quotes
never close on, tags end at the next ``>``; what follows an unfinished tag or comment is lost); ids and urls
may be null or repeat (one row each); an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import bound_batches, lean

#: Elements whose content is no text of the page.
_SILENT = frozenset("script style noscript template svg math iframe object canvas head title textarea select button audio video datalist".split())
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _SILENT}
_OPENING = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?/])")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
_VOID = frozenset(["hr"])
_AWAY = frozenset("nav footer aside form menu dialog fieldset".split())
_BODY = frozenset("article main".split())
_AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side aside widget footer masthead topbar toolbar"
    " comment comments discussion reply replies disqus respond related recommended share sharing social newsletter subscribe subscription signup login"
    " popup modal overlay gdpr copyright legal disclaimer contentinfo complementary search form dialog hidden tags rating ratings".split()
)
_BODY_NAMES = frozenset("article main content post entry story articlebody".split())
#: What the classifier sees of a block, and the log odds for content that one unit of each adds (fitted values).
FEATURES = ("always", "words", "linked", "sentence", "heading", "in_body", "away_element", "away_name", "page_header", "hidden", "outside")
WEIGHTS = (-1.3, 5.3, -8.0, 2.1, 5.4, 3.2, -13.0, -13.1, -9.2, -13.0, -9.8)
_SMOOTH = 1.0


@dataclass
class Element:
    """An open element: its depth and what its place says about text below it."""

    name: str
    depth: int
    parent: Element | None
    in_body: bool = False
    away_element: bool = False
    away_name: bool = False
    page_header: bool = False
    hidden: bool = False
    outside: bool = False
    #: What the element's own tag says, whatever it lies in.
    marks: tuple[bool, bool, bool] = (False, False, False)
    words: int = 0
    body_words: int = 0


@dataclass
class Block:
    parent: Element
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _child(parent: Element, name: str, attributes: str) -> Element:
    element = Element(name, parent.depth + 1, parent, parent.in_body, hidden=parent.hidden)
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            element.hidden = True
        elif key in ("class", "id", "role", "itemprop"):
            names.update(_NAME.findall(value))
    whole = name in ("body", "html", "article")
    element.in_body |= name in _BODY or bool(names & _BODY_NAMES)
    header = (name == "header" or "header" in names and not whole) and not parent.in_body
    element.marks = (name in _AWAY, bool(names & _AWAY_NAMES) and not whole, header)
    return element


def _place(blocks: list[Block]) -> None:
    """Hand the marks of elements down to what lies in them, but for marks of an element that wraps the page's text.

    The text is that of ``article`` and ``main`` elements; an element wraps it if it holds the first of them and more than half of
    their words.  On a page without them it holds more than half of all words, and 40 or more.
    ``outside`` is what lies in none of them, on a page that has them.
    """
    seen: dict[int, Element] = {}
    first = None
    for block in blocks:
        way, element = [], block.parent
        while element is not None and id(element) not in seen:
            seen[id(element)] = element
            way.append(element)
            element = element.parent
        for element in reversed(way):  # parents first
            element.outside = not (element.name in _BODY or element.parent is not None and not element.parent.outside)
        size = block.text.count(" ") + 1 if not block.parent.hidden and 2 * block.linked < len(block.text) else 0
        block.parent.words += size
        if not block.parent.outside:
            block.parent.body_words += size
            first = first or (block.parent if size else None)
    ordered = sorted(seen.values(), key=lambda e: e.depth)
    for element in reversed(ordered):
        if element.parent is not None:
            element.parent.words += element.words
            element.parent.body_words += element.body_words
    above = set()
    element = first
    while element is not None:
        above.add(id(element))
        element = element.parent
    for element in ordered:
        up = element.parent
        if up is None:
            whole = element
            continue
        if first is not None:
            wraps = id(element) in above and 2 * element.body_words > whole.body_words
        else:
            wraps = element.words >= 40 and 2 * element.words > whole.words
        marks = (False, False, False) if wraps else element.marks
        element.away_element, element.away_name, element.page_header = (a or b for a, b in zip(marks, (up.away_element, up.away_name, up.page_header)))
    if first is None:
        for element in ordered:
            element.outside = False


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of every tag; a silent element and a comment are one tag without a name."""
    at, quoted = 0, True
    while m := _OPENING.search(page, at):
        start, at = m.start(), m.end()
        name = (m[2] or "").lower()
        if not name:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, at)
            at = len(page) if end < 0 else end + len(mark)
            yield start, at, "", False, ""
            continue
        end, near = at, page.find(">", at)
        if near < 0:
            yield start, len(page), "", False, ""
            return
        if quoted and not m[1]:
            # The first ">" outside quotes.
            while True:
                quote = min((q for q in (page.find('"', end, near), page.find("'", end, near)) if q >= 0), default=-1)
                if quote < 0:
                    break
                close = page.find(page[quote], quote + 1)
                end = close + 1
                near = page.find(">", end) if close >= 0 and close > near else near
                if close < 0 or near < 0:
                    quoted, near = False, page.find(">", at)
                    break
        attributes, at = page[m.end() : near], near + 1
        if name in _SILENT and not m[1] and not attributes.endswith("/"):
            end_tag = _ENDS[name].search(page, at)
            at = end_tag.end() if end_tag else len(page)
            yield start, at, "", False, ""
        else:
            yield start, at, name, bool(m[1]), attributes


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in its order."""
    root = Element("", 0, None)
    top, links, at = root, 0, 0
    open_names: Counter[str] = Counter()
    found: list[Block] = []
    now = Block(root, False)

    def text(piece: str) -> None:
        if piece:
            now.pieces.append(piece)
            if links:
                now.linked += len(piece)

    def cut(parent: Element, heading: bool = False) -> Block:
        if now.pieces:
            now.text = " ".join(html.unescape("".join(now.pieces)).split())
            if now.text:
                found.append(now)
        return Block(parent, heading)

    for start, end, name, closes, attributes in tags_of(page):
        text(page[at:start])
        at = end
        if name == "br":
            text(" ")
        elif name == "a":
            links = 0 if closes else 1
        elif name in _BLOCKS:
            if closes:
                while open_names[name]:  # up to the element of that name, if one is open
                    open_names[top.name] -= 1
                    top, last = top.parent, top.name
                    if last == name:
                        break
            else:
                if top.name in _CLOSES_ITSELF and (top.name == name or top.name == "p"):
                    open_names[top.name] -= 1
                    top = top.parent
                if name not in _VOID:
                    top = _child(top, name, attributes)
                    open_names[name] += 1
            links = 0
            now = cut(top, name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closes)
    text(page[at:])
    cut(root)
    _place(found)
    return found


def features_of(block: Block) -> tuple[float, ...]:
    """The block's values of :data:`FEATURES`."""
    e, words = block.parent, block.text.count(" ") + 1
    return (
        1.0,
        min(words, 40) / 40,
        min(1.0, block.linked / max(len(block.text), 1)),
        float(block.text[-1] in ".!?…\"”"),
        float(block.heading),
        float(e.in_body),
        float(e.away_element),
        float(e.away_name),
        float(e.page_header),
        float(e.hidden),
        float(e.outside),
    )


def proximity(a: Element, b: Element) -> float:
    """Shared part of two places in the tree: 1 under one parent, less the further up their ways meet."""
    deepest = max(a.depth, b.depth)
    x, y = a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
    return (1 + x.depth) / (1 + deepest)


def _settle(gain: list[float], left: list[dict[int, float]]) -> list[int]:
    """Decide nodes whose terminal outweighs all their edges: 1 source, -1 sink, 0 doubtful.

    *gain* is the capacity to the source less that to the sink.  A decided
    neighbour is as good as its terminal, so its edge joins *gain*.
    """
    side = [0] * len(gain)
    around = [sum(x.values()) for x in left]
    queue = deque(range(len(gain)))
    while queue:
        i = queue.popleft()
        if side[i] or -around[i] < gain[i] <= around[i]:
            continue
        side[i] = 1 if gain[i] > 0 else -1
        for j, capacity in left[i].items():
            if not side[j]:
                gain[j] += side[i] * capacity
                around[j] -= capacity
                queue.append(j)
    return side


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the least minimum cut, by blocking flows along shortest ways (Dinic)."""
    n = len(source)
    left: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        left[a][b] = left[a].get(b, 0.0) + capacity
        left[b][a] = left[b].get(a, 0.0) + capacity
    gain = [a - b for a, b in zip(source, sink)]
    side = _settle(gain, left)
    doubtful = [i for i in range(n) if not side[i]]
    ways = {i: [j for j in left[i] if not side[j]] for i in doubtful}
    while True:
        depth = {i: 0 for i in doubtful if gain[i] > 1e-9}
        queue, reached = deque(depth), False
        while queue:
            i = queue.popleft()
            reached |= gain[i] < -1e-9
            for j in ways[i]:
                if j not in depth and left[i][j] > 1e-9:
                    depth[j] = depth[i] + 1
                    queue.append(j)
        if not reached:
            return [side[i] > 0 or i in depth for i in range(n)]
        turn = dict.fromkeys(depth, 0)
        for start in [i for i in depth if gain[i] > 1e-9]:
            path = [start]
            while path and gain[start] > 1e-9:
                i = path[-1]
                if gain[i] < -1e-9:
                    flow = min([gain[start], -gain[i], *(left[x][y] for x, y in zip(path, path[1:]))])
                    gain[start] -= flow
                    gain[i] += flow
                    for x, y in zip(path, path[1:]):
                        left[x][y] -= flow
                        left[y][x] += flow
                    path = path[:1]
                    continue
                while turn[i] < len(ways[i]):
                    j = ways[i][turn[i]]
                    if left[i][j] > 1e-9 and depth.get(j) == depth[i] + 1:
                        path.append(j)
                        break
                    turn[i] += 1
                else:
                    path.pop()
                    if path:
                        turn[path[-1]] += 1


def costs_of(blocks: list[Block]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """What calling each block boilerplate or content costs, and the edges between blocks with what parting them costs."""
    odds = (np.array([features_of(b) for b in blocks]) @ np.array(WEIGHTS)).tolist()
    # The logistic costs log(1 + exp(+-odds)) of either label.
    as_away = [math.log1p(math.exp(max(-30.0, min(z, 30.0)))) for z in odds]
    as_content = [math.log1p(math.exp(max(-30.0, min(-z, 30.0)))) for z in odds]
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, _SMOOTH * proximity(blocks[i - 1].parent, block.parent)))
        family = id(block.parent.parent)
        if last.get(family, i - 1) != i - 1:
            edges.append((last[family], i, 0.5 * _SMOOTH))
        last[family] = i
    return as_away, as_content, edges


def main_text(page: str) -> str:
    """The content blocks of a page, one per line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    content = minimum_cut(*costs_of(blocks))
    return "\n".join(b.text for b, kept in zip(blocks, content) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
