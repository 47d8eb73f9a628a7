"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees, level by level: split feature and threshold of inner nodes, values of leaves."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, leaf: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for logistic loss; second-order gains, quantile bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = at - first
            best = np.full(width, 1e-6)
            cut = np.full(width, BINS)
            pick = np.zeros(width, dtype=np.int64)
            for j in range(m):
                slot = own * BINS + binned[:, j]
                g = np.bincount(slot, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(slot, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + leaf) + gr**2 / (hr + leaf) - g[:, -1:] ** 2 / (h[:, -1:] + leaf)
                gain[(h < least) | (hr < least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], cut[better], pick[better] = top[better], k[better], j
            for k in range(width):
                feature[first + k] = pick[k]
                if cut[k] < len(edges[pick[k]]):
                    threshold[first + k] = edges[pick[k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        end = at - inner
        g, h = np.bincount(end, grad, inner + 1), np.bincount(end, hess, inner + 1)
        value = rate * g / (h + leaf)
        score += value[end]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, depth, np.array(features), np.array(thresholds), np.array(values))
