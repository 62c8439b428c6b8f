"""Main text of HTML pages by a tree-structured graphical model.

The nodes are a page's block elements and the runs of text in them; each is content (or
holds content) or not. A node's own potential is a weighted sum of features (tag, words of
class, id and role, share of linked words, length); each edge has a 2 x 2 potential between
parent and child. The graph is the page's tree, so one pass of sum-product messages from the
leaves to the root and one back give exact marginals; runs of text whose marginal of being
content is at least ``threshold`` are the result, in page order. The weights are trained by
the gradient of the conditional likelihood (observed minus expected features, the latter
from the same messages) on labelled pages.

Blocks: a run is what stands between two boundaries of block elements, its character
references decoded, its white space turned into single spaces and trimmed; runs are joined
by an empty line. ``head``, scripts, styles and other parts that no browser shows are never
nodes. Tags may be left open or cut off at the end of a page: ``head`` ends at the first tag
that can't stand in it, and another skipped element without an end tag ends where the block
around it ends.

Results for odd input: null and empty pages give the empty text, a page without tags is one
run; each row is taken by itself, so repeated rows give equal results; no rows give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parchment.llm.html_pages import labelled_pages

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<[!?][^>]*>|<[/A-Za-z!?][^>]*\Z", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Not shown, or not text: everything up to their end tag is skipped.
SKIPPED = frozenset("head script style noscript template iframe svg math object canvas audio video select textarea button datalist title".split())
#: Read raw: what looks like a tag in these is text.
RAW = frozenset("script style textarea title iframe".split())
#: May stand in one another.
NESTED = frozenset("svg object template".split())
#: Tags that leave ``head`` open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript object script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag in the key closes an open element of the value, unless one of SCOPE stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table article aside section div body html main nav header footer form blockquote".split())


class Page:
    """Nodes in document order; parents come before their children."""

    __slots__ = ("parent", "keys", "texts", "words", "linked", "gold")

    def __init__(self):
        self.parent, self.keys, self.texts, self.words, self.linked, self.gold = [], [], [], [], [], []

    def add(self, parent: int, key, text=None, words=0, linked=0, gold=False) -> int:
        self.parent.append(parent), self.keys.append(key), self.texts.append(text), self.words.append(words), self.linked.append(linked), self.gold.append(gold)
        return len(self.parent) - 1


def parse(source: str | None) -> Page:
    page = Page()
    stack = [("", page.add(-1, ("", ())), False)]  # (tag, node, gold)
    buffer: list[str] = []
    words_in_links = links = 0
    skip, at = "", 0  # skip: in head
    endless: set[str] = set()  # skipped tags without an end tag from here on
    unbalanced: set[str] = set()  # nesting ones that the page doesn't close as often as it opens them
    source = source or ""

    def flush() -> None:
        nonlocal words_in_links
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            n = text.count(" ") + 1
            page.add(stack[-1][1], None, text, n, min(n, words_in_links), stack[-1][2])
        words_in_links = 0

    def take(piece: str) -> None:
        nonlocal words_in_links, skip
        if skip and piece.strip():  # text ends head
            skip = ""
        if piece and not skip:
            piece = entities.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if links:
                words_in_links += len(piece.split())

    def own_end(tag: str, start: int) -> int:
        """Where the next end tag of that name begins, -1 if there is none."""
        if tag in endless:
            return -1
        found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, start)
        if found is None:
            endless.add(tag)
        return found.start() if found else -1

    def skipped_end(tag: str, start: int) -> int:
        """Where what is skipped ends: past its end tag, or where the block around it ends without one."""
        stop = own_end(tag, start)
        if tag in RAW and stop < 0:
            return len(source)
        if tag in RAW or tag == "noscript" and stop >= 0 and "<noscript" not in source[start:stop].lower():
            return source.find(">", stop) + 1 or len(source)
        level, inner, pos, block = 1, [], start, -1
        while (t := TAG.search(source, pos)) is not None:
            pos = t.end()
            if t[2] is None:
                continue
            name, closes = t[2].lower(), bool(t[1])
            if name in BLOCK:
                if stop < 0:
                    return t.start()  # never closed
                block = t.start() if block < 0 else block
                if not closes:
                    inner.append(name)
                elif name in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(name) :]
                elif any(s[0] == name for s in stack):
                    return t.start()
            elif name == tag and closes:
                level -= 1
                if not level:
                    return pos
            elif name == tag and tag in NESTED and tag not in unbalanced:
                level += 1
            elif name == tag and tag not in NESTED:
                return t.start() if block < 0 else block
            elif not closes and name in RAW and not t[3].rstrip().endswith("/"):
                pos = skipped_end(name, pos)
        unbalanced.add(tag)
        return len(source) if block < 0 else block

    while (m := TAG.search(source, at)) is not None:
        if m.start() > at:
            take(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, end = tag.lower(), bool(m[1])
        if skip and (end and tag in ("head", "body") or not end and tag not in IN_HEAD):
            skip = ""
            if tag == "head":
                continue
        if not end and tag in SKIPPED:
            if tag == "head":
                skip = "head" if all(s[0] in ("", "html") for s in stack) else ""
            elif not m[3].rstrip().endswith("/"):
                at = skipped_end(tag, at)
            continue
        if skip:
            continue
        if tag == "a":
            links = max(0, links + (-1 if end else 1))
        elif tag == "br":
            buffer.append("\n")
        elif tag in BLOCK:
            flush()
            links = 0
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            closing = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closing:
                    del stack[k:]
                elif stack[k][0] in SCOPE:
                    break
            if tag in ("html", "body") and any(s[0] == tag for s in stack):
                continue
            attrs = m[3]
            tokens = tuple(sorted({t for a in ATTR.finditer(attrs) for t in TOKEN.findall((a[2] or a[3] or a[4] or "").lower())})) if attrs else ()
            gold = stack[-1][2] or "data-gold" in attrs
            node = page.add(stack[-1][1], (tag, tokens), gold=gold)
            if tag not in VOID:
                stack.append((tag, node, gold))
    if at < len(source):
        take(source[at:])
    flush()
    for k in range(len(page.parent) - 1, 0, -1):
        page.words[page.parent[k]] += page.words[k]
        page.linked[page.parent[k]] += page.linked[k]
    return page


def _amount(n: int) -> int:
    return 0 if n == 0 else 1 if n < 4 else 2 if n < 12 else 3 if n < 40 else 4 if n < 150 else 5


def _share(part: int, n: int) -> int:
    return 0 if not part else 1 if part * 4 < n else 2 if part * 2 < n else 3


def features(page: Page, k: int) -> tuple[str, ...]:
    key, size, share = page.keys[k], _amount(page.words[k]), _share(page.linked[k], page.words[k])
    if key is None:
        up = page.keys[page.parent[k]]
        return ("run", f"run:{up[0]}", f"run:words{size}", f"run:links{share}", f"run:links{share}:words{size}")
    return ("node", f"tag:{key[0]}", f"tag:{key[0]}:named{bool(key[1])}", f"links{share}", f"words{size}", *(f"token:{t}" for t in key[1]))


class TreeModel:
    """weights of features, and edge potentials psi[parent][child] (00 stays 0)."""

    def __init__(self, weights: dict[str, float] | None = None, psi: list[list[float]] | None = None):
        self.weights, self.psi, self.memo = weights or {}, psi or [[0.0, -1.0], [0.0, 1.0]], {}

    def __reduce__(self):
        return TreeModel, (self.weights, self.psi)

    def own(self, page: Page, k: int) -> float:
        key = page.keys[k]
        mark = (key, page.keys[page.parent[k]][0] if key is None else "", _amount(page.words[k]), _share(page.linked[k], page.words[k]))
        if mark not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[mark] = sum(self.weights.get(f, 0.0) for f in features(page, k))
        return self.memo[mark]

    def messages(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """Log-odds: (subtree belief, message to the parent, full marginal) of each node."""
        n, parent = len(page.parent), page.parent
        (p00, p01), (p10, p11) = self.psi
        belief = [self.own(page, k) for k in range(n)]
        up, full = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            up[k] = p10 - p00 + _soft(belief[k] + p11 - p10) - _soft(belief[k] + p01 - p00)
            belief[parent[k]] += up[k]
        full[0] = belief[0]
        for k in range(1, n):
            a = full[parent[k]] - up[k]
            full[k] = belief[k] + p01 - p00 + _soft(a + p11 - p01) - _soft(a + p10 - p00)
        return belief, up, full

    def extract(self, page: Page, threshold: float = 0.5) -> str:
        least = 0.0 if threshold == 0.5 else -log1p(1 / threshold - 2) if threshold < 1 else float("inf")
        full = self.messages(page)[2]
        return "\n\n".join(t for t, f in zip(page.texts, full) if t is not None and f >= least)


def _soft(x: float) -> float:
    """log(1 + e^x)"""
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-x)) if x > -500 else 0.0


def train(pages: list[str], epochs: int = 25, rate: float = 0.4, decay: float = 1e-4) -> TreeModel:
    """pages: HTML whose content carries ``data-gold``. Adaptive gradient steps, page by page."""
    model, squares = TreeModel(), {}
    parsed = []
    for source in pages:
        page = parse(source)
        y = [int(g and t is not None) for g, t in zip(page.gold, page.texts)]
        for k in range(len(y) - 1, 0, -1):  # what holds content is content
            y[page.parent[k]] |= y[k]
        parsed.append((page, y, [features(page, k) for k in range(len(y))]))
    for _ in range(epochs):
        for page, y, feats in parsed:
            belief, up, full = model.messages(page)
            grad: dict = {}
            for k in range(len(y)):
                e = y[k] - _sigmoid(full[k])
                for f in feats[k]:
                    grad[f] = grad.get(f, 0.0) + e
            edges = [[0.0, 0.0], [0.0, 0.0]]
            for k in range(1, len(y)):
                a, b = full[page.parent[k]] - up[k], belief[k]
                cells = [[0.0, b], [a, a + b]]
                top = max(cells[i][j] + model.psi[i][j] for i in (0, 1) for j in (0, 1))
                mass = [[exp(cells[i][j] + model.psi[i][j] - top) for j in (0, 1)] for i in (0, 1)]
                z = sum(map(sum, mass))
                for i in (0, 1):
                    for j in (0, 1):
                        edges[i][j] += (y[page.parent[k]] == i and y[k] == j) - mass[i][j] / z
            n = len(y)
            for f, g in grad.items():
                g = g / n - decay * model.weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / squares[f] ** 0.5
            for i, j in ((0, 1), (1, 0), (1, 1)):
                g = edges[i][j] / n - decay * model.psi[i][j]
                squares[i, j] = squares.get((i, j), 1e-6) + g * g
                model.psi[i][j] += rate * g / squares[i, j] ** 0.5
            model.memo.clear()
    return model


@lru_cache(maxsize=2)
def default_model(n: int = 400) -> TreeModel:
    return train(labelled_pages(n))


def extract_text(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html", out: str = "text", threshold: float = 0.5) -> DataFrame:
    """pages with the main text in column ``out``; the HTML column stays only if ``out`` isn't its name."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for b in batches:
            yield pa.array([m.extract(parse(x), threshold) for x in b.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn(out, F.arrow_udf(run, "string")(F.coalesce(F.col(html_col), F.lit(""))))
