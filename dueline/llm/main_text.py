"""Main text of web pages by a minimum cut: content against boilerplate, block by block.

1. A page is read tag by tag into blocks: runs of text between block-level tags. Scripts, styles, comments,
   titles and form fields are no text; character references are decoded; white space becomes one space.
2. A block has a cell of six coarse features: what its ancestors are marked as (by tag, role, class or id:
   content, boilerplate by its words, boilerplate for certain, or nothing), share of linked text, number of
   words, sentence mark, kind of tag, and its neighbours' words.
3. A logistic model gives each cell the log-odds of content. It is trained here: blocks with a mark are its
   weak labels, and each counts once with its mark and once without it, so that the other features learn to
   stand alone. Spark counts the cells of about SAMPLE_PAGES pages (a parameter; chosen by a hash of their id
   and url), so what comes to the driver is bounded by the number of cells. A Gaussian prior around PRIOR keeps
   weights of features that a corpus doesn't show, and is the whole model of an empty table.
4. In a page, each block is a node. Its log-odds are its capacity to the source or the sink; edges tie blocks
   that follow each other, the weaker the further apart they are in the DOM, and blocks of one parent. The
   minimum cut labels all blocks at once. A node whose own capacity is at least that of all its edges lies
   on its own side of some minimum cut; such nodes are taken out first, again and again, which is exact, and
   max-flow (shortest augmenting paths) separates the rest.

Each page is one row's work: nothing is shuffled but the counts, so neither a hot host nor copies matter.

Defined results: null html is empty and has the text ''. All rows are returned, with repeated or null ids too.
Blocks are joined in page order by one space; none is dropped or cut for its length. What follows an unclosed
comment, script or style belongs to it; a tag cut off at the page's end is no text. Ties go to boilerplate.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dueline.llm.shared import fresh, text_or_empty

SAMPLE_PAGES = 2000

# HTML's tags by their role.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "select", "object"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTS = {"p", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figcaption", "caption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "div", "section", "article", "body"}
# How authors mark content and what surrounds it, as words of tags, roles, classes and ids.
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "noscript", "fieldset"}
CONTENT_WORDS = set("article articlebody main content post entry story maintext bodytext".split())
BOILERPLATE_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay dialog share sharing social "
    "follow related recommended recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup "
    "signin login register search widget toolbar copyright legal disclaimer contentinfo complementary skip hidden".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond discussion".split())

#: What a block's ancestors are marked as.
UNMARKED, CONTENT, WORDED, CERTAIN = range(4)
#: Levels of each feature of a cell: mark, linked share, words, sentence mark, kind of tag, neighbours' words.
LEVELS = (4, 4, 7, 2, 3, 4)
LINKED, WORDS, AROUND = (0.05, 0.3, 0.6), (2, 5, 10, 20, 40, 80), (5, 15, 40)
#: Mean of the prior for each level, and its precision.
PRIOR = (
    (0.0, 3.0, -5.0, -8.0),
    (0.5, 0.0, -1.5, -3.0),
    (-1.5, -1.0, -0.5, 0.5, 1.0, 1.5, 2.0),
    (-0.5, 0.5),
    (0.5, 0.5, -0.5),
    (-0.5, 0.0, 0.5, 0.5),
)
PRECISION = 4.0
#: Capacity of an edge between blocks next to each other in page and DOM, and between blocks of one parent.
NEXT, SIBLING = 1.5, 0.5

_TOKEN = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*(?:>|\Z)|(?P<torn>[a-zA-Z][^>]*)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKING = re.compile(r"class|id\s*=|role|itemprop|hidden|display", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@lru_cache(1 << 14)
def raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


@lru_cache(1 << 14)
def own_mark(tag: str, attrs: str) -> tuple[int, bool]:
    """What an element is marked as by itself, and whether it may be content within boilerplate."""
    words: set[str] = set()
    item = False
    if attrs and _MARKING.search(attrs):
        if _HIDDEN.search(attrs):
            return CERTAIN, False
        for name, value in _ATTRIBUTE.findall(attrs):
            if (name := name.lower()) in ("class", "id", "role", "itemprop"):
                words |= {w.lower() for w in _WORD.findall(value)}
                item |= name == "itemprop" and "articlebody" in value.lower()
    if words & COMMENT_WORDS or tag in BOILERPLATE_TAGS:
        return CERTAIN, False
    strong = tag in CONTENT_TAGS or item
    if tag in ("html", "body"):
        return UNMARKED, False
    if words & BOILERPLATE_WORDS and not item:
        return WORDED, False
    if tag == "header":
        return WORDED, False
    return (CONTENT if strong or words & CONTENT_WORDS else UNMARKED), strong


def inherited(parent: int, tag: str, attrs: str) -> int:
    """What an element is marked as below a parent."""
    own, strong = own_mark(tag, attrs)
    if parent == CERTAIN or own == CERTAIN:
        return CERTAIN
    if tag == "header" and parent == CONTENT and own_mark("div", attrs)[0] != WORDED:
        return CONTENT  # an article's own header
    if own == WORDED or (parent == WORDED and not strong):
        return WORDED
    return CONTENT if CONTENT in (own, parent) else UNMARKED


class Page:
    """The blocks of a page: texts, cells, DOM distances to the block before, and parents."""

    def __init__(self, html: str) -> None:
        self.texts: list[str] = []
        self.marks: list[int] = []
        self.linked: list[float] = []
        self.words: list[int] = []
        self.kinds: list[int] = []
        self.distances: list[int] = []
        self.parents: list[int] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int]] = [("", UNMARKED, 0)]  # tag, mark, number
        runs: list[str] = []
        in_links, links, serial, last_depth, lowest, at, n = 0, 0, 0, 1, 1, 0, len(html)

        def flush() -> None:
            nonlocal in_links, last_depth, lowest
            if not runs:
                return
            text = "".join(runs)
            runs.clear()
            linked, in_links = in_links, 0
            parts = text.split()
            if not parts:
                return
            # Inline elements have no part in where a block is.
            depth = len(stack)
            while depth > 1 and stack[depth - 1][0] in INLINE:
                depth -= 1
            tag = stack[depth - 1][0]
            text = " ".join(parts)
            self.texts.append(text)
            self.marks.append(max(stack[-1][1], stack[depth - 1][1]))
            self.linked.append(linked / len(text))
            self.words.append(len(parts))
            self.kinds.append(0 if tag in TEXTS else 1 if tag in HEADINGS else 2)
            low = min(lowest, depth, last_depth)
            self.distances.append(last_depth + depth - 2 * low)
            self.parents.append(stack[max(0, depth - 2)][2])
            last_depth = lowest = depth

        while at < n:
            found = _TOKEN.search(html, at)
            start = found.start() if found else n
            if start > at:
                text = html[at:start]
                if "&" in text:
                    text = unescape(text)
                runs.append(text)
                if links:
                    in_links += len(text.strip())
            if not found:
                break
            at = found.end()
            name = found["open"] or found["torn"]
            if name:
                if found["torn"] and not html.endswith(">", 0, at):
                    break  # cut off
                attrs = found["attrs"] or ""
                tag = name.split(None, 1)[0].lower() if found["torn"] else name.lower()
                if tag in RAW:
                    if not attrs.endswith("/"):
                        end = raw_end(tag).search(html, at)
                        at = end.start() if end else n
                elif tag in VOID:
                    if tag in ("br", "hr"):
                        runs.append(" ")
                elif tag in INLINE:
                    links += tag == "a"
                    serial += 1
                    stack.append((tag, inherited(stack[-1][1], tag, attrs), serial))
                else:
                    flush()
                    closed = CLOSES.get(tag, {"p"})
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] in closed:
                            links -= sum(e[0] == "a" for e in stack[depth:])
                            del stack[depth:]
                            lowest = min(lowest, depth)
                            break
                        if stack[depth][0] in FENCES or (tag not in CLOSES and stack[depth][0] not in INLINE):
                            break
                    serial += 1
                    stack.append((tag, inherited(stack[-1][1], tag, attrs), serial))
            elif found["close"]:
                tag = found["close"].lower()
                if tag not in INLINE:
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        links -= sum(e[0] == "a" for e in stack[depth:])
                        del stack[depth:]
                        lowest = min(lowest, depth)
                        break
                    if tag in INLINE and stack[depth][0] not in INLINE:
                        break
        flush()

    def cells(self) -> list[int]:
        """The number of each block's cell."""
        out, n = [], len(self.texts)
        for i in range(n):
            around = (self.words[i - 1] if i else 0) + (self.words[i + 1] if i + 1 < n else 0)
            text = self.texts[i]
            levels = (
                self.marks[i],
                level(LINKED, self.linked[i]),
                level(WORDS, self.words[i]),
                int(text[-1] in ".!?…。" or (len(text) > 1 and text[-1] in "\"'”’»)" and text[-2] in ".!?…。")),
                self.kinds[i],
                level(AROUND, around),
            )
            cell = 0
            for own, size in zip(levels, LEVELS):
                cell = cell * size + own
            out.append(cell)
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """Between blocks that follow each other, and between each block and the one before of its parent."""
        out: list[tuple[int, int, float]] = []
        last: dict[int, int] = {}
        for i in range(len(self.texts)):
            if i:
                out.append((i - 1, i, NEXT / (1 + self.distances[i])))
            before = last.get(self.parents[i])
            if before is not None:
                out.append((before, i, SIBLING))
            last[self.parents[i]] = i
        return out


def level(bounds: tuple, value: float) -> int:
    return sum(value > b for b in bounds)


# Minimum cut -----------------------------------------------------------------------------------


def minimum_cut(terminals: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Is each node on the source's side of a minimum cut? A positive terminal is a capacity from the source,
    a negative one to the sink; edges have one capacity for both directions."""
    n = len(terminals)
    own, near = list(terminals), [dict[int, float]() for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(own[i]) >= sum(near[i].values()):
            side[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if side[i] else -c
                del near[j][i]
                if side[j] is None:
                    todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, s in zip(rest, _max_flow([own[i] for i in rest], {i: k for k, i in enumerate(rest)}, near)):
            side[i] = s
    return [bool(s) for s in side]


def _max_flow(terminals: list[float], number: dict[int, int], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths from the source; then what the source still reaches."""
    n = len(terminals)
    left = [dict[int, float]() for _ in range(n)]
    for i, k in number.items():
        for j, c in near[i].items():
            left[k][number[j]] = c
    supply, demand = [max(t, 0.0) for t in terminals], [max(-t, 0.0) for t in terminals]
    tiny = 1e-12
    while True:
        before = {k: -1 for k in range(n) if supply[k] > tiny}
        queue, end = deque(before), -1
        while queue and end < 0:
            k = queue.popleft()
            if demand[k] > tiny:
                end = k
                break
            for j, c in left[k].items():
                if c > tiny and j not in before:
                    before[j] = k
                    queue.append(j)
        if end < 0:
            return [k in before for k in range(n)]
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        flow = min(supply[path[-1]], demand[end], *(left[a][b] for b, a in zip(path, path[1:])))
        supply[path[-1]] -= flow
        demand[end] -= flow
        for b, a in zip(path, path[1:]):
            left[a][b] -= flow
            left[b][a] = left[b].get(a, 0.0) + flow


# Model -----------------------------------------------------------------------------------------


def design() -> np.ndarray:
    """A row for each cell: 1 for the level it has of each feature."""
    levels = np.stack(np.unravel_index(np.arange(math.prod(LEVELS)), LEVELS), axis=1)
    starts = np.concatenate([[0], np.cumsum(LEVELS)[:-1]])
    out = np.zeros((len(levels), sum(LEVELS)))
    for f, start in enumerate(starts):
        out[np.arange(len(levels)), start + levels[:, f]] = 1.0
    return out


def log_odds(counts: dict[int, int]) -> np.ndarray:
    """For each cell the log-odds of content, from how many blocks of each cell there are."""
    rows, prior = design(), np.concatenate([np.array(p) for p in PRIOR])
    per_mark = math.prod(LEVELS[1:])
    marks, linked = np.arange(len(rows)) // per_mark, np.arange(len(rows)) // math.prod(LEVELS[2:]) % LEVELS[1]
    number = np.zeros(len(rows))
    for cell, n in counts.items():
        number[cell] = n
    labelled = ((marks == CONTENT) & (linked < 3)) | (marks >= WORDED)
    number, content = np.where(labelled, number, 0.0), (marks == CONTENT).astype(float)
    own = np.flatnonzero(number)
    unmarked = own % per_mark  # UNMARKED is the first level
    x = np.concatenate([rows[own], rows[unmarked]])
    y, weight = np.tile(content[own], 2), np.tile(number[own], 2)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - PRECISION * (w - prior)
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step / max(1.0, np.abs(step).max())  # at most 1 at a time, as Newton's steps may overshoot
        if np.abs(step).max() < 1e-6:
            break
    return rows @ w


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> np.ndarray:
    """Log-odds of all cells, from the blocks of about ``sample_pages`` pages: those whose hash lies in that
    share of all hashes, so that copies of a page are chosen together."""
    share = min(1.0, sample_pages / max(1, pages.count()))
    last = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    chosen = pages.where(F.xxhash64(id_column, url_column) <= last).select(text_or_empty(F.col(html_column)).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c for html in batch.column(0).to_pylist() for c in Page(html).cells()]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32())], names=["cell"])

    counts = chosen.mapInArrow(run, "cell int").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return log_odds({r.cell: r.n for r in counts.collect()})


def main_text(html: str, odds: list[float]) -> str:
    page = Page(html)
    chosen = minimum_cut([odds[c] for c in page.cells()], page.edges())
    return " ".join(text for text, is_content in zip(page.texts, chosen) if is_content)


def with_main_text(pages: DataFrame, name: str, odds: np.ndarray, html_column: str = "html") -> DataFrame:
    """The rows with all their columns and the main text of their html."""
    held, names, table = fresh(pages, "main_text_html"), [*pages.columns, name], odds.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, table) for html in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    schema = StructType([*pages.schema.fields, StructField(name, StringType())])
    return pages.withColumn(held, text_or_empty(F.col(html_column))).mapInArrow(run, schema)


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    odds = train(pages, sample_pages, id_column, url_column, html_column)
    narrow = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    texts = with_main_text(narrow, "text", odds)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
