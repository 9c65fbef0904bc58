"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down.

A page becomes a tree of its block elements. Each node has features of itself (tag, tokens of tag, id, class and role), of its
subtree (text, links, tags, signs, density), of its place (depth, position among siblings, share of the parent's text) and
of its ancestors' tokens. Trees are learned on a bounded sample of pages that mark their article; for every other
page of the sample that mark is hidden, so the trees do not lean on it alone. Decoding picks the labelling of highest likelihood
in which no node under a rejected node is kept.

White space inside a block becomes one space, blocks are joined by line feeds in page order; scripts, styles, head and
comments are no text, nor is what stands in buttons, select lists, drawings, objects, templates, noscript, iframes and text areas; formulas are
text. A button (or another of ``SILENT``) that has no end tag before its ancestor ends hides nothing; only ``RAW`` elements without
an end tag go to the end of the page. Broken markup is read as far as it goes.

Defined results: null and empty pages give the empty text; pages without any block give their text if there is any; rows that
repeat repeat; where no page of the sample marks an article, nodes without a token of page furniture count as one; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that are learned from: those with the least hash of id and address.
TRAIN_PAGES = 400
TREES, LEVELS, RATE, BINS = 30, 3, 0.3, 32

# Elements without an end tag, elements inside a line of text, elements that hold no text to read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd mspace semantics".split()
)
#: Elements whose content is no markup, and elements whose content is markup but not read.
RAW = frozenset("script style title iframe textarea".split())
SILENT = frozenset("noscript template svg object select button annotation annotation-xml".split())
#: What an element that begins also ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
SCOPES = frozenset("html body article section main div table ul ol dl nav aside footer header form blockquote figure td th".split())
#: Words by which pages name their furniture, and their article.
FURNITURE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer foot ad ads advert adverts advertisement sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay form forms subscribe newsletter signup login search share "
    "sharing social related recommended widget widgets toolbar pagination pager comment comments commentlist disqus reply replies respond "
    "copyright legal disclaimer skip".split()
)
TOP = frozenset({"header", "masthead", "topbar"})
STORY = frozenset("article main content post entry story text body".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SIGNS = re.compile(r"[.,;:!?]")


class Page:
    """Block elements in page order: tag, parent, tokens, and pieces of text as (node, text, linked characters)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.inner = ["#page"], [-1], [0]
        self.furniture, self.top, self.story = [0], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._parts: list[str] = []
        self._linked = self._links = 0
        self._read(source)

    def _flush(self, node: int) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _say(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    @staticmethod
    def _reveal(hush: list[tuple[str, int]], endless: set[int]) -> int:
        """Silent elements that are still open have no end: they hide nothing. Returns the place to read again from."""
        at = hush[0][1]
        endless.update(place for name, place in hush if name in SILENT)
        hush.clear()
        return at

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]
        # elements that are open from a silent one on, each with the place after its tag; silent ones that turned out to have no end
        hush: list[tuple[str, int]] = []
        endless: set[int] = set()
        inline: Counter[str] = Counter()
        node, at, end = 0, 0, source.rfind(">") + 1
        while True:
            m = _TAG.search(source, at, end) if at < end else None
            if m is None and not hush:
                break
            if m is None:
                at = self._reveal(hush, endless)
                continue
            if not hush:
                self._say(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing = name.lower(), m[1] or m[4]
            alone = m[0].endswith("/>")
            if name in RAW and not closing:
                if alone and any(n == "svg" for n, _ in hush):
                    continue
                stop = re.compile("</" + re.escape(name) + r"(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else len(source)
                end = max(end, at) if stop else at
                continue
            if hush:
                if closing:
                    k = next((k for k in range(len(hush) - 1, -1, -1) if hush[k][0] == name), -1)
                    if k >= 0:
                        del hush[k:]
                        if not hush:
                            self._flush(node)
                            self._links = 0
                    elif inline[name] or any(n == name for n, _ in stack):
                        at = self._reveal(hush, endless)
                elif name not in VOID and not (alone and (name == "svg" or any(n == "svg" for n, _ in hush))):
                    hush.append((name, at))
                continue
            if name in SILENT and not closing:
                if at not in endless and not (alone and name == "svg"):
                    hush.append((name, at))
                continue
            if name in INLINE or name in VOID:
                self.inner[node] += 1
                if name in INLINE and not alone:
                    inline[name] = max(0, inline[name] - 1) if closing else inline[name] + 1
                if name == "a":
                    self._links = 0 if closing else 1
                elif name not in VOID:
                    pass
                elif name in ("br", "hr", "img"):
                    self._parts.append(" ")
                continue
            self._flush(node)
            self._links = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES and name not in SCOPES:
                        break
            else:
                ended = ENDS.get(name, ()) if name in ENDS else ()
                for k in range(len(stack) - 1, 0, -1):
                    open_ = stack[k][0]
                    if open_ == "p" or open_ in ended:
                        del stack[k:]
                    elif open_ in SCOPES or open_ in ("li", "tr"):
                        break
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.inner.append(0)
                tokens = {name}
                attributes = m[3] or m[6]
                if attributes and name not in ("html", "body"):
                    for found in _NAMES.findall(attributes):
                        tokens.update(t.lower() for t in _TOKEN.findall(found[0] or found[1] or found[2]))
                self.furniture.append(len(tokens & FURNITURE))
                self.top.append(len(tokens & TOP))
                self.story.append(len(tokens & STORY) if name not in ("html", "body") else 0)
                stack.append((name, len(self.tag) - 1))
            node = stack[-1][1]
        self._say(source[at:])
        self._flush(node)


_KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "div": 5, "section": 5, "table": 6, "tr": 6, "td": 6, "form": 7}
FEATURES = 20
#: Of splits that are equally good, those by names come first: they hold for pages of other templates, too.
FIRST = (15, 18, 14, 17, 16)


def features(page: Page, hide_story: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all nodes, and the nodes' parents."""
    n, parent = len(page.tag), page.parent
    own, linked, signs = [0] * n, [0] * n, [0] * n
    for node, text, link in page.blocks:
        own[node] += len(text)
        linked[node] += link
        signs[node] += len(_SIGNS.findall(text))
    text, link, sign, tags, below, children = own[:], linked[:], signs[:], page.inner[:], [1] * n, [0] * n
    for v in range(n - 1, 0, -1):
        u = parent[v]
        text[u] += text[v]
        link[u] += link[v]
        sign[u] += sign[v]
        tags[u] += tags[v] + 1
        below[u] += below[v]
        children[u] += 1
    depth, place, bad, good, top, count = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for v in range(1, n):
        u = parent[v]
        depth[v] = depth[u] + 1
        place[v] = count[u]
        count[u] += 1
        good[v] = max(good[u], 0 if hide_story else min(1, page.story[v]))
        # the head of a page is furniture, the head of its article is not
        top[v] = max(top[u], min(1, page.top[v])) if not good[v] else top[u]
        bad[v] = max(bad[u], min(1, page.furniture[v]), top[v])
    a = lambda x: np.asarray(x, np.float32)
    up = np.maximum(np.array(parent), 0)
    t, k, s = a(text), a(link), a(sign)
    out = np.stack(
        [
            np.log1p(a(own)), np.log1p(t), k / np.maximum(t, 1), t / (a(tags) + 1), s / np.maximum(t, 1) * 100, np.log1p(a(below)), a(depth), a(place),
            a(children)[up], a(place) / np.maximum(a(children)[up], 1), t / np.maximum(t[up], 1), t / max(1.0, float(t[0])), a(children),
            a([_KINDS.get(x, 0) for x in page.tag]), a([min(1, x) for x in page.furniture]), a(bad), np.zeros(n, np.float32) if hide_story else a([min(1, x) for x in page.story]),
            a(good), a(top), k[up] / np.maximum(t[up], 1),
        ],
        axis=1,
    )
    return out, np.array(parent)


class Trees:
    """Boosted trees of a fixed depth for the logistic loss."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        inner, leaves = (1 << LEVELS) - 1, 1 << LEVELS
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), base)
        feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
        for tree in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(len(y), np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = (1e-3, 0, np.inf, 0)
                if len(rows) > 1:
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for f in (*FIRST, *(f for f in range(len(cuts)) if f not in FIRST)):
                        c = cuts[f]
                        if not len(c):
                            continue
                        sg = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))
                        sh = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))
                        gain = sg[:-1] ** 2 / (sh[:-1] + 1) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + 1) - whole
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, float(c[k]), k)
                feature[tree, node], cut[tree, node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
            at -= inner
            value = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
            leaf[tree] = value
            score += value[at]
        return cls(feature, cut, leaf, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def decode(score: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the likeliest labelling in which parents of kept nodes are kept. The first node is the page."""
    yes, no = (-np.logaddexp(0, -score)).tolist(), (-np.logaddexp(0, score)).tolist()
    up, n = parent.tolist(), len(score)
    drop, best = no[:], yes[:]
    for v in range(n - 1, 0, -1):
        # what is below v has been added to both by now
        u = up[v]
        drop[u] += drop[v]
        best[u] += max(drop[v], best[v])
    keep = [True] * n
    for v in range(1, n):
        keep[v] = keep[up[v]] and best[v] > drop[v]
    return np.array(keep)


def _labels(page: Page) -> np.ndarray | None:
    """Weak labels: what is inside the marked article and no furniture; None without such a mark."""
    n = len(page.tag)
    inside, bad = [False] * n, [False] * n
    for v in range(1, n):
        inside[v] = inside[page.parent[v]] or page.tag[v] in ("article", "main")
        bad[v] = bad[page.parent[v]] or page.furniture[v] > 0
    return np.array(inside) & ~np.array(bad) if any(inside) else None


def fit(pages: list[str]) -> Trees:
    x, y, plain = [], [], []
    for i, source in enumerate(pages):
        page = Page(source)
        rows, parent = features(page, hide_story=i % 2 == 1)
        label = _labels(page)
        plain.append((rows[1:], rows[1:, 15] == 0))
        if label is not None:
            # what holds the article is kept with it
            for v in range(len(label) - 1, 0, -1):
                label[parent[v]] |= label[v]
            x.append(rows[1:])
            y.append(label[1:])
    if not x or len(np.unique(np.concatenate(y))) < 2:
        x, y = [r for r, _ in plain], [p for _, p in plain]
    if not sum(map(len, x)):
        x, y = [np.zeros((1, FEATURES), np.float32)], [np.ones(1)]
    return Trees.fit(np.concatenate(x), np.concatenate(y).astype(float))


def main_text(source: str, trees: Trees) -> str:
    page = Page(source)
    rows, parent = features(page)
    keep = decode(trees.score(rows), parent)
    return "\n".join(text for node, text, _ in page.blocks if keep[node])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = fit([t or "" for batch in batches for t in batch.column("html").to_pylist()])
    yield pa.RecordBatch.from_pydict(
        {
            "tree": pa.array(range(TREES), pa.int32()), "feature": trees.feature.tolist(), "cut": trees.cut.tolist(), "leaf": trees.leaf.tolist(), "base": [trees.base] * TREES,
        }
    )


def train(pages: DataFrame, bound: int = TRAIN_PAGES) -> Trees:
    """Learn in one task from a bounded sample; a few hundred numbers come back to the driver."""
    key = F.xxhash64("page_id", "url")
    # the ids first: no page that is not chosen leaves its task, and a second limit holds where an id has many rows
    chosen = pages.select(key.alias("_key")).orderBy("_key").limit(bound)
    sample = pages.select("page_id", "url", "html", key.alias("_key")).join(F.broadcast(chosen), "_key", "left_semi")
    sample = sample.orderBy("_key", "page_id", "url", F.xxhash64("html")).limit(bound)
    got = sample.select("html").mapInArrow(_train, "tree int, feature array<bigint>, cut array<double>, leaf array<double>, base double").orderBy("tree").toArrow()
    if not got.num_rows:
        return fit([])
    column = lambda c: np.array(got.column(c).to_pylist())
    return Trees(column("feature"), column("cut"), column("leaf"), float(column("base")[0]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages))

    @F.arrow_udf("string")
    def text(sources: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(sources), 200):
            parsed = [Page(s or "") for s in sources.slice(k, 200).to_pylist()]
            shapes = [features(p) for p in parsed]
            score = shared.value.score(np.concatenate([rows for rows, _ in shapes]))
            at = 0
            for page, (rows, parent) in zip(parsed, shapes, strict=True):
                keep = decode(score[at : at + len(rows)], parent)
                at += len(rows)
                out.append("\n".join(t for node, t, _ in page.blocks if keep[node]))
        return pa.array(out, pa.string())

    return pages.select("page_id", "url", text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
