"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element of the page is a binary variable: content or not; so are inline elements that are
hidden or whose class speaks against content. Its features (tag, words of
its class, id and role, text, links, place) give a local potential, and each parent-child pair has a
potential that depends on the kind of the child. Sum-product messages, upwards and then downwards,
give the exact marginals; a block's own text is taken if its marginal of being content exceeds one
half. Weights are fitted by gradient ascent on the likelihood of labelled pages, whose gradient is
the difference between observed and expected features under the same messages. The labelled pages
are built from page layouts in ``html_training``.

Text is decoded, white space inside a block becomes one space, and blocks are joined in page order
by one space.

Defined results. A null or empty page, and one without content blocks, has an empty text. Broken
markup is read leniently: unclosed elements end with their parents, a page may end anywhere. Text in
math belongs to the block around it; xmp and the fallback in object, canvas and noscript are blocks
like others; svg, template, math annotations, script, style, title and form or frame texts are not read. Pages
without any markup are one block and are taken. Very long and deeply nested pages are read whole,
without recursion. Repeated rows are alike. An empty table gives an empty result. Other columns,
whatever their names, are carried along untouched.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import small_batches
from weftgraph.llm.html_dom import Block, attributes, parse

TAGS = (
    "body main article section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption dl dt dd "
    "nav header footer aside form button select fieldset head details dialog menu address"
).split()
#: Words in class, id or role that speak for a kind of block.
HINTS = {
    "content": "article content post entry story body text main prose markdown chapter page-content articlebody".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pager pagination toc topbar tabs links navlinks skip".split(),
    "header": "header masthead branding logo banner hero-bar top site-header".split(),
    "footer": "footer foot copyright colophon legal bottom imprint disclaimer".split(),
    "side": "sidebar side aside widget rail column-right column-left complementary secondary".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner-ad adsense dfp".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall subscribe newsletter signup toast warning announcement message".split(),
    "form": "form login search searchbox contact input signin register".split(),
    "comments": "comment comments reply replies respond disqus discussion reader-comments feedback review reviews commentlist".split(),
    "share": "share sharing social related recommended recommendations more tags meta byline trending popular also-read follow".split(),
}
_HINTED = {word: kind for kind, words in HINTS.items() for word in words}
_KINDS = ("section", "text", "list", "other", "article")  # of the child; twice, the second time below a parent with a hint against content
_KIND = {t: k for k, tags in enumerate(["div section main figure body", "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption", "ul ol li dl dt dd table tr td th tbody", "", "article"]) for t in tags.split()}
_FEATURES = ["bias", *(f"tag:{t}" for t in TAGS), "tag:?", *(f"hint:{h}" for h in HINTS), "hidden", "links", "long", "short", "ends", "stops", "paragraphs"]
_INDEX = {name: i for i, name in enumerate(_FEATURES)}
#: Elements that the labelled pages lack, with what the model takes them for.
_LIKE = {"xmp": "pre", "object": "div", "canvas": "div", "noscript": "div", "details": "div", "summary": "p"}
_NOT_SHOWN = frozenset({"head"})
EPOCHS = 300


def hints(attrs: dict[str, str]) -> set[str]:
    words = set()
    for name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
        if value := attrs.get(name):
            words |= {w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value)} | set(re.split(r"[\s_]+", value.lower()))
    return {_HINTED[w] for w in words if w in _HINTED}


def apart(text: str) -> bool:
    """Whether the attributes of an inline element make it a variable of its own: hidden, or hinted at as no content."""
    known, hidden, label = _of_attributes(text)
    return hidden or bool(label) or any(k != _INDEX["hint:content"] for k in known)


@functools.lru_cache(maxsize=20_000)
def _of_attributes(text: str) -> tuple[tuple[int, ...], bool, str]:
    """Feature indices of the hints, whether the block is hidden, and its label in a labelled page."""
    attrs = attributes(text)
    style = attrs.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return tuple(sorted(_INDEX[f"hint:{h}"] for h in hints(attrs))), hidden, attrs.get("data-y", "")


def features(blocks: list[Block]) -> tuple[list[list[tuple[int, float]]], list[int]]:
    """Sparse features and the kind of each block."""
    n = len(blocks)
    own = [sum(len(t) for _, t in b.segments) for b in blocks]
    total, linked, paragraphs = own[:], [b.link_chars for b in blocks], [0] * n
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        total[p] += total[i]
        linked[p] += linked[i]
        paragraphs[p] += blocks[i].tag == "p" and own[i] > 0
    rows, kinds = [], []
    for i, b in enumerate(blocks):
        known, hidden, label = _of_attributes(b.attrs)
        row = [(0, 1.0), (_INDEX.get(f"tag:{_LIKE.get(b.tag, b.tag)}", _INDEX["tag:?"]), 1.0), *((k, 1.0) for k in known)]
        if hidden:
            row.append((_INDEX["hidden"], 1.0))
        row.append((_INDEX["links"], min(1.0, linked[i] / (total[i] + 1))))
        row.append((_INDEX["long"], min(1.0, math.log1p(total[i]) / 8)))
        row.append((_INDEX["short"], 1.0 if 0 < total[i] < 25 else 0.0))
        if b.segments:
            row.append((_INDEX["ends"], 1.0 if b.segments[-1][1][-1] in ".!?:;»”\"" else 0.0))
            row.append((_INDEX["stops"], min(1.0, sum(t.count(". ") + t.count(",") for _, t in b.segments) / 5)))
        row.append((_INDEX["paragraphs"], min(1.0, paragraphs[i] / 3)))
        rows.append(row)
        b.hidden, b.label = hidden, int(label) if label else None
        against = b.parent >= 0 and any(k != _INDEX["hint:content"] for k in _of_attributes(blocks[b.parent].attrs)[0])
        kinds.append(_KIND.get(_LIKE.get(b.tag, b.tag), 3) + len(_KINDS) * against)
    return rows, kinds


def levels(blocks: list[Block]) -> list[int]:
    """Depth of each block; parents come before their children."""
    depth: list[int] = []
    for b in blocks:
        depth.append(depth[b.parent] + 1 if b.parent >= 0 else 0)
    return depth


class Forest:
    """The trees of many pages as one graph: sparse features, and the edges of each depth."""

    def __init__(self, pages: list[list[Block]]) -> None:
        self.starts = np.cumsum([0] + [len(p) for p in pages])
        parents, depth, kinds, rows, cols, values = [], [], [], [], [], []
        for start, blocks in zip(self.starts.tolist(), pages, strict=False):
            own, kind = features(blocks)
            parents += [b.parent + start if b.parent >= 0 else -1 for b in blocks]
            depth += levels(blocks)
            kinds += kind
            for i, row in enumerate(own, start):
                rows += [i] * len(row)
                cols += [k for k, _ in row]
                values += [x for _, x in row]
        self.parents, self.kinds = np.array(parents, np.int64), np.array(kinds, np.int64)
        self.rows, self.cols, self.values = np.array(rows, np.int64), np.array(cols, np.int64), np.array(values)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:] if len(order) else []

    def local(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.cols] * self.values, minlength=len(self.parents))


def marginals(forest: Forest, local: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on the trees, in log odds. local: log odds of each block's own potential;
    pair[kind, parent's state, child's state]: log potentials. Gives P(content) of each block, and the
    joint of (parent, child) as states 00, 01, 10, 11 of each block that has a parent."""
    up, message = local.copy(), np.zeros_like(local)
    for own in reversed(forest.levels):
        a = pair[forest.kinds[own]]
        message[own] = np.logaddexp(a[:, 1, 0], a[:, 1, 1] + up[own]) - np.logaddexp(a[:, 0, 0], a[:, 0, 1] + up[own])
        np.add.at(up, forest.parents[own], message[own])
    belief, joint = up.copy(), np.zeros((len(local), 4))
    for own in forest.levels:
        a = pair[forest.kinds[own]]
        outside = belief[forest.parents[own]] - message[own]
        belief[own] = up[own] + np.logaddexp(a[:, 0, 1], a[:, 1, 1] + outside) - np.logaddexp(a[:, 0, 0], a[:, 1, 0] + outside)
        w = np.stack([a[:, 0, 0], a[:, 0, 1] + up[own], a[:, 1, 0] + outside, a[:, 1, 1] + outside + up[own]], axis=1)
        w = np.exp(w - w.max(axis=1, keepdims=True))
        joint[own] = w / w.sum(axis=1, keepdims=True)
    return 1 / (1 + np.exp(-np.clip(belief, -500, 500))), joint


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights, pair

    def content(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """P(content) of the blocks of each page."""
        forest = Forest(pages)
        found = marginals(forest, forest.local(self.weights), self.pair)[0]
        return [found[a:b] for a, b in zip(forest.starts, forest.starts[1:], strict=False)]


def train(pages: list[str], epochs: int = EPOCHS, rate: float = 0.2, shrink: float = 2e-3) -> Model:
    """Maximum likelihood by Adam from pages whose blocks carry data-y="1" or "0"; a block without it is as its parent."""
    parsed = [parse(p, apart) for p in pages]
    forest, labels = Forest(parsed), []
    for blocks in parsed:
        own: list[int] = []
        for b in blocks:
            own.append(b.label if b.label is not None else own[b.parent] if b.parent >= 0 else 0)
        labels += own
    y, n = np.array(labels), len(_FEATURES)
    child = np.flatnonzero(forest.parents >= 0)
    slot = 4 * forest.kinds[child]
    seen = np.bincount(slot + 2 * y[forest.parents[child]] + y[child], minlength=8 * len(_KINDS)).astype(float)
    theta = np.zeros(n + 8 * len(_KINDS))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        pair = theta[n:].reshape(-1, 2, 2)
        marginal, joint = marginals(forest, forest.local(theta[:n]), pair)
        local = np.bincount(forest.cols, (y - marginal)[forest.rows] * forest.values, minlength=n)
        expected = np.zeros(8 * len(_KINDS))
        for s in range(4):
            expected += np.bincount(slot + s, joint[child, s], minlength=8 * len(_KINDS))
        gradient = np.concatenate([local, seen - expected]) / len(pages) - shrink * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) / (1 + step / 100)
    return Model(theta[:n], theta[n:].reshape(-1, 2, 2))


@functools.cache
def default_model() -> Model:
    from weftgraph.llm.html_training import labelled_pages

    return train(labelled_pages())


def judged(pages: list[str], model: Model) -> tuple[int, int]:
    """Of labelled pages how many blocks with text are judged wrongly, and how many there are."""
    parsed, wrong, total = [parse(p, apart) for p in pages], 0, 0
    for blocks, chances in zip(parsed, model.content(parsed), strict=True):
        labels: list[int] = []
        for b in blocks:
            labels.append(b.label if b.label is not None else labels[b.parent] if b.parent >= 0 else 0)
        texts = [i for i, b in enumerate(blocks) if b.segments]
        total += len(texts)
        wrong += sum((chances[i] > 0.5) != labels[i] for i in texts)
    return wrong, total


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "", apart) for p in pages]
    out = []
    for blocks, chances in zip(parsed, model.content(parsed), strict=True):
        hidden, found = [False] * len(blocks), []
        for i, b in enumerate(blocks):
            hidden[i] = b.hidden or b.tag in _NOT_SHOWN or (i > 0 and hidden[b.parent])
            if (chances[i] > 0.5 or len(blocks) == 1) and not hidden[i]:
                found += b.segments
        out.append(" ".join(t for _, t in sorted(found)))
    return out


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """row (a struct of all columns) and text of every row."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    @F.pandas_udf("string")
    def text_of(raw: pd.Series) -> pd.Series:
        texts = [main_texts(raw[at : at + 64].tolist(), shared.value) for at in range(0, len(raw), 64)]
        return pd.Series([t for some in texts for t in some], dtype=object)

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    return rows.select("row", text_of(F.col(f"row.`{html_col}`").cast("string")).alias("text"))
