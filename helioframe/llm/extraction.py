"""Main text of web pages by a tree-structured graphical model.

The variables are the block elements of a page, content or not.  Each has a potential
from its features, and each parent-child edge one from the kind of child; messages
pass from the leaves to the root and back, which gives exact marginals.  The weights
are fitted to labelled pages by the likelihood's gradient: labelled minus expected
counts, both from the same message passing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.llm import dom, kernel, labelled_pages
from helioframe.llm.common import ship

STEPS, RATE, SHRINK = 300, 1.0, 1e-3
_SPLIT = re.compile(r"[^a-z]+")
#: Kinds of an edge: the child is plain, a part of a page by its tag, or has a name.
_PARTS = frozenset("article main section nav aside header footer form table ul ol menu dl address dialog".split())


def features(page: dom.Page) -> list[list[str]]:
    """Names of the features that hold for each block element."""
    own = [0] * len(page.tag)
    stops = [0] * len(page.tag)
    for k, text in page.runs:
        own[k] += len(text)
        stops[k] += text.count(".") + text.count(",")
    out = []
    for k, tag in enumerate(page.tag):
        n = own[k]
        size = 0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 250 else 4
        f = ["bias", f"tag={tag}", f"size={size}"]
        if n:
            share = page.linked[k] / n
            f.append("links=" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
            f.append("stops=" + ("0" if stops[k] == 0 else "1" if stops[k] < 3 else "3"))
        if k:
            f.append(f"parent={page.tag[page.parent[k]]}")
        if page.names[k]:
            f += [f"name={w}" for w in set(_SPLIT.split(page.names[k])) if w]
        out.append(f)
    return out


def kind(page: dom.Page, k: int) -> int:
    return 2 if page.names[k] else 1 if page.tag[k] in _PARTS else 0


class Forest:
    """Block elements of several pages, with feature numbers, edge kinds and depths."""

    def __init__(self, pages: list[dom.Page], known: dict[str, int]):
        self.offset = np.concatenate(([0], np.cumsum([len(p.tag) for p in pages]))).astype(np.int64)
        node, feature, parent, kinds, depth = [], [], [], [], []
        for at, p in zip(self.offset.tolist(), pages, strict=False):
            for k, names in enumerate(features(p)):
                hit = [known[x] for x in names if x in known]
                node += [at + k] * len(hit)
                feature += hit
                kinds.append(kind(p, k))
            parent += [q + at if q >= 0 else -1 for q in p.parent]
            depth += p.depth
        as_int = lambda x: np.array(x, dtype=np.int64)
        self.node, self.feature, self.parent, self.kinds, self.depth = map(as_int, (node, feature, parent, kinds, depth))
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)] if len(depth) else []


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(forest: Forest, weight: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each element, and P(parent label, child label) of each edge, by sum-product.

    ``weight`` scores content per feature; ``edge[kind, parent label, child label]``.
    """
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.node, weights=weight[forest.feature], minlength=n)
    below, up = own.copy(), np.zeros((n, 2))
    for level in forest.levels[:0:-1]:  # upward: children to parents
        up[level] = _log_sum(edge[forest.kinds[level]] + below[level][:, None, :], 2)
        np.add.at(below, forest.parent[level], up[level])
    above = np.zeros((n, 2))
    pair = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:  # downward: parents to children
        q = forest.parent[level]
        rest = above[q] + below[q] - up[level]
        joint = rest[:, :, None] + edge[forest.kinds[level]]
        above[level] = _log_sum(joint, 1)
        joint = joint + below[level][:, None, :]
        pair[level] = np.exp(joint - _log_sum(joint.reshape(len(level), 4), 1)[:, None, None])
    belief = above + below
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


def labels(page: dom.Page) -> np.ndarray:
    out = np.zeros(len(page.tag), dtype=np.int64)
    for k in range(1, len(page.tag)):
        mark = page.label[k]
        out[k] = out[page.parent[k]] if mark is None else mark == "content"
    return out


@lru_cache(maxsize=4)
def train(labelled: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Weights of features and edges that fit the labelled pages."""
    pages = [dom.read(h) for h in labelled]
    seen: dict[str, set[int]] = {}
    for i, p in enumerate(pages):
        for names in features(p):
            for x in names:
                seen.setdefault(x, set()).add(i)
    known = {x: i for i, x in enumerate(sorted(x for x, at in seen.items() if len(at) > 1))}
    forest, y = Forest(pages, known), np.concatenate([labels(p) for p in pages])
    has = forest.parent >= 0
    want_edge = np.zeros((3, 2, 2))
    np.add.at(want_edge, (forest.kinds[has], y[forest.parent[has]], y[has]), 1)
    want = np.bincount(forest.feature, weights=y[forest.node].astype(float), minlength=len(known))
    count = np.maximum(np.bincount(forest.feature, minlength=len(known)), 1)
    weight, edge = np.zeros(len(known)), np.zeros((3, 2, 2))
    speed, edge_speed = np.zeros_like(weight), np.zeros_like(edge)
    for _ in range(STEPS):
        p, pair = marginals(forest, weight, edge)
        got = np.bincount(forest.feature, weights=p[forest.node], minlength=len(known))
        got_edge = np.zeros_like(edge)
        np.add.at(got_edge, forest.kinds[has], pair[has])
        speed = 0.8 * speed + RATE * ((want - got) / np.sqrt(count) / 20 - SHRINK * weight)
        edge_speed = 0.8 * edge_speed + RATE * ((want_edge - got_edge) / has.sum() - SHRINK * edge)
        weight, edge = weight + speed, edge + edge_speed
    return known, weight, edge


def extract_text(htmls: list[str | None], trained) -> list[str]:
    known, weight, edge = trained
    pages = [dom.read(h) for h in htmls]
    forest = Forest(pages, known)
    p, _ = marginals(forest, weight, edge)
    return ["\n".join(t for k, t in page.runs if p[at + k] >= 0.5 or len(page.tag) == 1) for at, page in zip(forest.offset.tolist(), pages, strict=False)]


def _extract(html: str, keep: list[str], trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernel.chunks(batches, html):
            texts = extract_text(piece.column(piece.schema.get_field_index(html)).to_pylist(), trained)
            yield pa.RecordBatch.from_arrays([*piece.select(keep).columns, pa.array(texts, pa.string())], [*keep, "text"])

    return run


def extract(pages: DataFrame, html: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of each page, and ``n_chars``, its code points.

    Returns the columns of ``pages`` but the html; input columns of the two names are
    replaced.  Blocks stand in page order, one a line; white space in a block is one
    space.  The weights (a number a feature) are fitted on the driver; ``labelled`` are pages with ``data-label`` marks (by default the built-in ones).

    A null or empty page, or one without content, gives ''.  Broken markup is read as
    far as it goes; a page without any markup is one block.  Equal pages give equal
    texts.  An empty table gives an empty table.
    """
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    trained = train(tuple(labelled_pages.pages() if labelled is None else labelled))
    return pages.select(*keep, html).mapInArrow(_extract(html, keep, trained), schema).withColumn("n_chars", F.length("text").cast("long"))
