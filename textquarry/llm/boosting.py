"""Histogram gradient-boosted trees in numpy, and their flattened form.

Training: features are cut into at most BINS quantile bins; a depth-wise tree picks each node's split
from the summed gradients per bin; logistic loss. A trained model is four arrays of shape
(trees, nodes): feature, threshold, left child (the right one follows it) and value; a leaf's children
are itself, so that scoring walks all rows down one level at a time, `depth` numpy steps per tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.left, self.value):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[node]
                node = left[node] + ((f >= 0) & (x[rows, f] > threshold[node]))
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _bins(x: np.ndarray) -> list[np.ndarray]:
    """Per feature the upper edges of its bins, halfway between values that occur."""
    edges = []
    for col in x.T:
        values = np.unique(col)
        if len(values) > BINS:
            values = np.unique(np.quantile(col, np.linspace(0, 1, BINS), method="nearest"))
        edges.append((values[:-1] + values[1:]) / 2)
    return edges


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least_rows: int = 5) -> Forest:
    """A forest for labels 0/1; with one label only, or no rows, it is the constant smoothed share."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    feature, threshold, value = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
    left = np.tile(np.arange(nodes, dtype=np.int32), (trees, 1))
    forest = Forest(feature, threshold, left, value, base, depth)
    if n < 2 * least_rows or y.min() == y.max():
        return forest
    edges = _bins(x)
    binned = np.stack([np.searchsorted(e, col) for e, col in zip(edges, x.T)], axis=1).astype(np.int64)
    columns = binned + np.arange(k) * BINS
    margin = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node, first, width = np.zeros(n, np.int64), 0, 1
        for level in range(depth + 1):
            at = node - first
            g, h = np.bincount(at, grad, width), np.bincount(at, hess, width)
            value[t, first : first + width] = rate * g / (h + l2)
            if level == depth:
                break
            key = (at[:, None] * (k * BINS) + columns).ravel()
            size = width * k * BINS
            shaped = lambda w: np.bincount(key, w, size).reshape(width, k, BINS).cumsum(axis=2)  # noqa: E731, B023
            gl, hl, cl = shaped(np.repeat(grad, k)), shaped(np.repeat(hess, k)), shaped(np.ones(n * k))
            gr, hr, cr = g[:, None, None] - gl, h[:, None, None] - hl, cl[:, :, -1:] - cl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (g**2 / (h + l2))[:, None, None]
            gain[(cl < least_rows) | (cr < least_rows)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            spot = first + np.flatnonzero(split)
            feature[t, spot] = f[split]
            threshold[t, spot] = [edges[i][j] for i, j in zip(f[split], b[split])]
            left[t, spot] = 2 * spot + 1
            goes = binned[np.arange(n), f[at]] > b[at]
            node = 2 * node + 1 + goes  # nodes that don't split keep both children at the parent's value
            for s in first + np.flatnonzero(~split):
                value[t, 2 * s + 1 : 2 * s + 3] = value[t, s]
            first, width = 2 * first + 1, 2 * width
        margin += _walk(feature[t], threshold[t], left[t], value[t], x, depth)
    return forest


def _walk(feature, threshold, left, value, x, depth):
    node, rows = np.zeros(len(x), np.int32), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = left[node] + ((f >= 0) & (x[rows, f] > threshold[node]))
    return value[node]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots (score, calibrated probability), both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest score
    for s, label in zip(score[order], y[order]):
        blocks.append([float(label), 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys
