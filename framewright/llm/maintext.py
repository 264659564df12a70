"""HTML extraction: minimum-cut labelling of blocks.

A page is split into blocks of text at block-level tags. A block's log-odds of being content are its capacity to a
terminal of a graph. They are the sum of two parts: what the markup around it says (elements and class names, stated
weights), and what a logistic classifier makes of the block itself, its length, links, marks, letters and kind and those
of its neighbours. The classifier is fitted on the table's own pages, SAMPLE of them at most: blocks that the markup
leaves no doubt of are its examples, and markup is not among its features, so it can judge blocks whose markup says
nothing. Its odds are bounded by TEXT. Edges between neighbouring blocks, and between blocks next to each other in the
same container (proximity in the tree of elements), are the cost of labelling them apart; they are of the order of
unsure odds, so a short paragraph between long ones stays with them. The minimum cut, found as maximum flow, separates
content from boilerplate.

Defined cases: null and empty pages, and pages without content, give an empty text; broken markup is read as far as
it goes (open elements end with the page, a cut-off tag is dropped, an element whose inside is no text and that is not
closed hides nothing, save script, style and the like, which by the rules of HTML take the rest of the page); repeated
rows and null ids are kept; without examples of both kinds the classifier has stated weights; an empty table gives an
empty result; other columns are left aside.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, tidy, workers_find_package
from .logistic import fit

# Fixed values of HTML: elements that end a block, elements whose inside is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template textarea title svg math iframe object select button head canvas audio video".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens ends the open one before it, if that is of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Log-odds of a block by where it is. Elements that say nothing are left out.
INSIDE = {"article": 3.0, "main": 1.5, "nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "header": -3.0, "dialog": -7.0, "menu": -7.0}
NAMED_BAD, NAMED_GOOD, HIDDEN = -7.0, 1.5, -9.0
BAD = re.compile(r"^(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|replies|respond|disqus|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|foot|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|copyright|skip)$", re.I)
GOOD = re.compile(r"^(article|content|entry|post|story|main|body|text)$", re.I)
#: Bound of the classifier's log-odds; edges between neighbours, and between blocks next to each other in a container.
TEXT, NEXT, SIBLING = 2.0, 0.4, 0.8
#: Pages that the classifier is fitted on, at most.
SAMPLE = 400
FEATURES = ["log_words", "linked", "stops", "word_length", "capitals", "digits", "heading", "paragraph", "item", "log_words_before", "log_words_after", "linked_before", "linked_after"]
#: Weights of FEATURES, and the bias, where there is nothing to learn from.
STATED = np.array([0.8, -4.0, 0.5, 0.0, 0.0, 0.0, 0.5, 0.7, -0.5, 0.0, 0.0, 0.0, 0.0, -2.0])
#: Elements that hold a block each; the container of such a block is what they stand in.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th div pre blockquote figcaption".split())
HEADINGS, ITEMS = frozenset(["h1", "h2", "h3"]), frozenset(["li", "td", "th", "dt", "dd"])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^>]*\Z", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDES = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:until|false))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Block:
    """text, letters of it in links, log-odds by markup, number of its container, its element."""

    __slots__ = ("text", "linked", "odds", "parent", "tag")

    def __init__(self, text: str, linked: int, odds: float, parent: int, tag: str):
        self.text, self.linked, self.odds, self.parent, self.tag = text, linked, odds, parent, tag


def _of_element(tag: str, attributes: str) -> float:
    """What an element adds to the log-odds of the blocks within it."""
    odds = INSIDE.get(tag, 0.0)
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for found in NAMES.findall(attributes):
            parts = re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", "".join(found))
            if any(BAD.match(p) for p in parts if p):
                odds += NAMED_BAD
            elif any(GOOD.match(p) for p in parts if p):
                odds += NAMED_GOOD
        if HIDES.search(attributes):
            odds += HIDDEN
    return odds


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # open block-level elements: tag, number, log-odds so far
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = number = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            tag, own, odds = stack[-1]
            parent = stack[-2][1] if len(stack) > 1 and tag in LEAVES else own
            out.append(Block(joined, linked, odds, parent, tag))
        text.clear()
        linked = 0

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def put(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        if in_link:
            linked += len("".join(piece.split()))
        text.append(piece)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not (attributes.endswith("/") and tag in ("svg", "math")):
                e = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if e:
                    at = e.end()
                elif tag in RAW:
                    at = end
            text.append(" " if tag in ("button", "select") else "")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            flush()
            if closing:
                while opened[tag]:  # an end tag that ends nothing costs nothing, however deep the page is
                    if leave() == tag:
                        break
            else:
                if len(stack) > 1 and stack[-1][0] == "p":
                    leave()
                if len(stack) > 1 and stack[-1][0] in ENDS.get(tag, ()):
                    leave()
                if tag not in VOID:
                    number += 1
                    good = tag != "header" or not opened["article"]
                    stack.append((tag, number, stack[-1][2] + (_of_element(tag, attributes) if good else 0.0)))
                    opened[tag] += 1
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """FEATURES of blocks, a row for each, none of them from the elements or names around it."""
    own = []
    for b in blocks:
        words, letters = b.text.count(" ") + 1, max(1, len(b.text) - b.text.count(" "))
        stops = sum(map(b.text.count, ".,;:!?"))
        capitals, digits = sum(map(str.isupper, b.text)), sum(map(str.isdigit, b.text))
        own.append((math.log(words), min(1.0, b.linked / letters), min(1.0, stops / words), min(2.0, letters / words / 10), capitals / letters, digits / letters, b.tag in HEADINGS, b.tag == "p", b.tag in ITEMS))
    x = np.array(own, float).reshape(len(blocks), 9)
    edge = np.zeros((1, 9))
    before, after = np.vstack([edge, x[:-1]])[: len(x)], np.vstack([x[1:], edge])[: len(x)]
    return np.column_stack([x, before[:, 0], after[:, 0], before[:, 1], after[:, 1]])


def log_odds(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Of each block: by its markup, and by the classifier."""
    text = np.clip(features(blocks) @ weights[:-1] + weights[-1], -TEXT, TEXT)
    return (np.array([b.odds for b in blocks]) + text).tolist()


def fitted(pages: list[str]) -> np.ndarray:
    """Weights of FEATURES and the bias, from blocks that the markup leaves no doubt of."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        sure = [k for k, b in enumerate(blocks) if b.odds >= INSIDE["article"] or b.odds <= NAMED_BAD]
        if sure:
            x.append(features(blocks)[sure])
            y += [float(blocks[k].odds > 0) for k in sure]
    if len(set(y)) < 2:
        return STATED
    x, label = np.vstack(x), np.array(y)
    share = np.where(label > 0, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    w, bias = fit(x, label, share, 1e-3)
    return np.append(w, bias)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours on the page, and next to each other in a container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut, where node i is bound to the source by odds[i] if
    that is positive and to the sink by -odds[i] if not, and edges bind both ways. Dinic's maximum flow."""
    n = len(odds)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i, z in enumerate(odds):
        join(source, i, z, 0.0) if z > 0 else join(i, sink, -z, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, u = [], source
                continue
            g = graph[u]
            while at[u] < len(g) and not (cap[g[at[u]]] > 1e-12 and level[to[g[at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(g):
                path.append(g[at[u]])
                u = to[g[at[u]]]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
            else:
                break


def extract(page: str | None, weights: np.ndarray = STATED) -> str:
    blocks = blocks_of(page or "")
    kept = min_cut(log_odds(blocks, weights), smoothness(blocks)) if blocks else []
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def model(pages: DataFrame) -> np.ndarray:
    """fitted() on the SAMPLE pages whose ids have the smallest hashes; of rows with one id, the one of smallest hash.
    Ids are chosen from their column alone, and the pages are then read by them."""
    ids = pages.filter(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    rows = pages.filter(F.col("page_id").cast("long").isin([r.id for r in ids])).select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    first = rows.groupBy("page_id").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("r")).select("page_id", "r.html").collect()
    found = fitted([r.html for r in sorted(first, key=lambda r: r.page_id)])
    tidy()
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    workers_find_package(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    weights = model(pages)

    def run(batches):
        for b in batches:
            texts = [extract(h, weights) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
