"""Main text of web pages by minimum-cut labelling of their blocks.

The page is split into blocks of text. A learned classifier's log odds of each block being content are its terminal
capacity: towards the source for content, towards the sink for boilerplate. Blocks that follow each other and blocks
under the same element are joined by edges, stronger the nearer they are in the tree, in proportion to the page's mean
terminal. The maximal flow separates the two kinds; blocks from which the sink can still be reached are boilerplate, the
rest is the article.

The classifier sees a block's length, sentences, share of link text, element, depth and place in the page, and the
elements and names above it as hashed features; nothing is added to what it says. It is fitted by logistic regression on
about SAMPLE_PAGES pages of the table whose elements say what they are (article against nav, footer, named adverts and so on: the rules
of _teach, which give examples alone: features know article and main elements, and names by their hashes). Every example is fitted twice, once with the names withheld, so that pages without telling names
are judged by the rest.

Scripts, styles, comments, forms and the head are no blocks at all; a form around an article element, or around FORM_TEXT characters of paragraphs, is read as its
inside is, without its fields and buttons. Formulas and the fallback text of objects are text, noscript is inside articles alone. Character references are decoded, white
space inside a block is one space, blocks are joined by one space in page order. Null and empty pages, and
pages without content, give an empty string. Malformed markup is read as browsers do as far as blocks go: open
elements end with their parents, an unfinished tag or comment ends the page. Repeated rows give repeated
results. Null ids and urls are passed on; an empty table gives no rows. Pages of any length are fitted and cut alike; the flow
is near-linear, since searches that reach no sink are never repeated.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common

TOKEN = re.compile(r"<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "audio", "video"}
SKIP = {"head", "form", "select", "button", "datalist"}  # nothing inside is a block, unless a form holds an article
FORM_END = re.compile(r"</form\s*>", re.I)
PARAGRAPH = re.compile(r"<p\b[^>]*>(.*?)(?=</p|<p\b|\Z)", re.I | re.S)
FORM_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
FORM_TEXT = 400  # characters in paragraphs that make a form's inside an article
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
VOID = {"hr"}
BOILER_TAGS = {"nav": 9.0, "footer": 9.0, "aside": 9.0, "menu": 8.0, "dialog": 8.0}
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|comments?|commentlist|disqus|respond|repl(?:y|ies)|sidebar|side|widget|menu|nav\w*|navbar|breadcrumbs?|footer|foot|header|masthead|topbar|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|popup|modal|overlay|login|search|pagination|pager|tags?|copyright|legal|toolbar|contentinfo|navigation|complementary)(?:$|[\s_-])",
    re.I,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
SCALE = 100
NEXT, SAME_PARENT = 0.2, 0.3  # of the page's mean terminal
NAME_SLOTS = 1024  # hashed features of elements and names
WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    odds: float = 0.0  # what the elements above and this one teach: above 0 content, below boilerplate
    taught: bool = False  # the elements or names above teach that this is an article
    inside: bool = False  # an article or main element is above
    names: frozenset[int] = frozenset()  # hashed elements and names, this one's and those above


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # letters inside links
    heading: bool = False
    edges: list[tuple[int, float]] = field(default_factory=list)


def _teach(node: Node, above: Node, names: str) -> None:
    """What an element says of the blocks in it; examples for fitting come from this, results don't."""
    tag = node.tag
    if tag in BOILER_TAGS:
        node.odds -= BOILER_TAGS[tag]
    elif tag == "header" and not above.taught:
        node.odds -= 9.0
    elif tag in ("article", "main") and not above.taught:
        node.odds, node.taught = node.odds + 5.0, True
    elif names and tag not in ("body", "html"):
        if BOILER_NAMES.search(names):
            node.odds -= 9.0 if above.taught else 7.0
        elif CONTENT_NAMES.search(names) and not above.taught:
            node.odds, node.taught = node.odds + 3.0, True


def _node(tag: str, attrs: str, parent: Node | None) -> Node:
    above = parent or Node("", None, 0)
    node = Node(tag, parent, above.depth + 1, above.odds, above.taught, above.inside or tag in ("article", "main"))
    names = " ".join(m.strip("\"'") for m in NAMED.findall(attrs)) if attrs else ""
    _teach(node, above, names)
    inside = "in" if above.inside else "out"
    said = [f"{tag} {inside}", *(f".{w}" for w in WORDS.findall(names.lower()))]
    node.names = above.names | {crc32(x.encode()) % NAME_SLOTS for x in said} if tag not in ("html", "body") else above.names
    return node


def _holds_article(html: str, at: int) -> bool:
    """Whether a form that begins at this place is around an article: it has such an element, or paragraphs of some length."""
    stop = FORM_END.search(html, at)
    inner = html[at : stop.start() if stop else len(html)]
    return bool(FORM_ARTICLE.search(inner)) or sum(len(re.sub(r"<[^>]*>", "", p)) for p in PARAGRAPH.findall(inner)) >= FORM_TEXT


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    root = Node("", None, 0)
    at, node, link, skip = 0, root, 0, 0
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not skip:
                out.append(Block(text, node, linked, node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(html):
        if m.start() < at:  # inside raw text
            continue
        if m.start() > at:
            part = html[at : m.start()]
            parts.append(part)
            linked += len(part) if link else 0
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if tag in RAW and not closing and not (tag == "noscript" and node.inside):
            if not m["attrs"].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag in SKIP:
            end_block()
            if closing:
                above = node
                while above is not root and above.tag != tag:
                    above = above.parent
                if above is root and tag == "form":
                    continue
                if above is not root:
                    while node is not above.parent:
                        skip -= node.tag in SKIP
                        node = node.parent
            elif tag not in VOID:
                ends = SELF_ENDING.get(tag, {"p"} if node.tag == "p" else ())
                while node.tag in ends or node.tag == "p":
                    node = node.parent
                open_form = tag == "form" and _holds_article(html, at)
                node = _node("div" if open_form else tag, m["attrs"], node)
                skip += node.tag in SKIP
                if tag == "body":  # a head that was never closed ends here
                    skip = 0
    if at < len(html):
        parts.append(html[at:])
    end_block()
    return out


SAMPLE_PAGES, SAMPLE_BLOCKS = 1_000, 12_000  # about so many pages and blocks of them at most are fitted on
SURE = 3.0  # what a block's elements must teach to make it an example
#: Weights of block_features that fitting starts from and is drawn back to; names start with none.
PRIOR = np.array((-1.6, 0.55, 0.5, -4.0, 0.6, 1.2, -0.6, -2.0, 0.0, 0.0, 0.0, 0.0))
RIDGE, NAME_RIDGE = 2.0, 0.3


def block_features(block: Block, at: int, n_blocks: int) -> tuple[float, ...]:
    """What block number at of n_blocks is like, names aside."""
    n, tag = len(block.text), block.node.tag
    stops = sum(block.text.count(c) for c in ".!?")
    rights = "©" in block.text[:40] or "all rights reserved" in block.text[:200].lower()
    place = (at + 0.5) / n_blocks
    return (
        1.0, log1p(n / 8), float(min(stops, 4)), min(1.0, block.linked / n), float(tag == "p"), float(block.heading), float(tag in ("li", "td", "th", "dt", "dd")), float(rights),
        float(at == 0), float(at == n_blocks - 1), abs(2 * place - 1), min(block.node.depth, 12) / 4,
    )


class Weights:
    """The classifier: weights of block_features and of the hashed names."""

    def __init__(self, own: np.ndarray = PRIOR, names: np.ndarray | None = None):
        self.own, self.names = [float(v) for v in own], [0.0] * NAME_SLOTS if names is None else [float(v) for v in names]

    def log_odds(self, found: list[Block]) -> list[float]:
        above: dict[frozenset[int], float] = {}
        out = []
        for k, b in enumerate(found):
            if b.node.names not in above:
                above[b.node.names] = sum(self.names[i] for i in b.node.names)
            own = sum(w * x for w, x in zip(self.own, block_features(b, k, len(found)), strict=True))
            out.append(max(-4.0, min(4.0, own)) + max(-12.0, min(12.0, above[b.node.names])))
        return out


def fit_weights(x: np.ndarray, names: np.ndarray, y: np.ndarray) -> Weights:
    """Logistic regression, both kinds of examples weighing alike, each example with its names and without."""
    if not ((y == 0).any() and (y == 1).any()):
        return Weights()
    used = np.flatnonzero(names.any(0))
    k = x.shape[1]
    z = np.concatenate([np.hstack([x, names[:, used]]), np.hstack([x, np.zeros((len(x), len(used)))])])
    t = np.concatenate([y, y])
    weight = np.where(t == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    prior, ridge = np.append(PRIOR, np.zeros(len(used))), np.append(np.full(k, RIDGE), np.full(len(used), NAME_RIDGE))
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - t)) + ridge * (w - prior)
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    out = np.zeros(NAME_SLOTS)
    out[used] = w[k:]
    return Weights(w[:k], out)


def fit(pages: DataFrame) -> Weights:
    """Weights from blocks whose elements say what they are, of a sample of pages."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, h in zip(b.column("page").to_pylist(), b.column("html").to_pylist(), strict=True):
                found = blocks(h or "")
                rows = [(block_features(x, k, len(found)), sorted(x.node.names), float(x.node.odds > 0), page, k) for k, x in enumerate(found) if abs(x.node.odds) >= SURE]
                if rows:
                    types = (pa.list_(pa.float64()), pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["x", "names", "y", "page", "k"])

    some = common.sampled(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), SAMPLE_PAGES, "page_id", "url", hard=False).select(F.xxhash64("page_id", "url").alias("page"), "html")
    found = common.work_table(some.mapInArrow(examples, "x array<double>, names array<int>, y double, page long, k long"), "block-examples")
    rows = sorted((tuple(r.x), r.y, tuple(r.names)) for r in common.sampled(found, SAMPLE_BLOCKS, "page", "k").collect())
    common.discard(found)
    if not rows:
        return Weights()
    names = np.zeros((len(rows), NAME_SLOTS))
    for i, r in enumerate(rows):
        names[i, list(r[2])] = 1
    return fit_weights(np.array([r[0] for r in rows]), names, np.array([r[1] for r in rows]))


def _near(found: list[Block], mean: float) -> list[dict[int, int]]:
    """Smoothness capacities between neighbours in the page and in the tree; mean: the mean terminal."""
    edges: list[dict[int, int]] = [{} for _ in found]

    def join(i: int, j: int, weight: float) -> None:
        c = int(mean * weight)
        if c > 0:
            edges[i][j] = edges[i].get(j, 0) + c
            edges[j][i] = edges[j].get(i, 0) + c

    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a, z = found[i - 1].node, b.node
            steps = 0
            while a is not z:
                if a.depth >= z.depth:
                    a = a.parent
                else:
                    z = z.parent
                steps += 1
            join(i - 1, i, NEXT / (1 + steps / 2))
        parent = id(b.node.parent) if b.node.parent is not None else id(b.node)
        if parent in last and last[parent] < i - 1:
            join(last[parent], i, SAME_PARENT / 2)
        elif parent in last:
            join(i - 1, i, SAME_PARENT)
        last[parent] = i
    return edges


def min_cut(terminal: list[int], edges: list[dict[int, int]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut (the largest such side).

    terminal: capacity from the source if positive, to the sink if negative. edges: symmetric capacities.
    """
    left = list(terminal)
    room = [dict(e) for e in edges]
    closed = [False] * len(left)  # a search from here met no sink: no later path enters
    for start in range(len(left)):
        while left[start] > 0 and not closed[start]:
            came, queue, goal = {start: -1}, deque([start]), -1
            while queue:
                i = queue.popleft()
                if left[i] < 0:
                    goal = i
                    break
                for j, c in room[i].items():
                    if c > 0 and j not in came and not closed[j]:
                        came[j] = i
                        queue.append(j)
            if goal < 0:
                for i in came:
                    closed[i] = True
                break
            path = [goal]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            flow = min(-left[goal], left[start], min((room[i][j] for j, i in zip(path, path[1:], strict=False)), default=left[start]))
            left[start] -= flow
            left[goal] += flow
            for j, i in zip(path, path[1:], strict=False):
                room[i][j] -= flow
                room[j][i] = room[j].get(i, 0) + flow
    sink = {i for i, x in enumerate(left) if x < 0}
    queue = deque(sink)
    while queue:
        j = queue.popleft()
        for i in room[j]:
            if i not in sink and room[i].get(j, 0) > 0:
                sink.add(i)
                queue.append(i)
    return [i not in sink for i in range(len(left))]


def main_text(html: str, weights: Weights) -> str:
    found = blocks(html)
    if not found:
        return ""
    odds = [int(SCALE * x) or -1 for x in weights.log_odds(found)]
    kept = min_cut(odds, _near(found, sum(map(abs, odds)) / len(odds)))
    return " ".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; without weights the classifier is fitted on these pages."""
    weights = weights or fit(pages)

    def texts(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(h or "", weights) for h in b.column("html").to_pylist()]
        cols = [b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(common.per_batch(texts), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
