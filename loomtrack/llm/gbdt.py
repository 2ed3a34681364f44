"""Histogram gradient-boosted trees in numpy, kept as flat arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node k's children are 2k+1 and 2k+2; a row goes right where value > threshold."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner] if len(node) else 0
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 2.0) -> Trees:
    """Logistic loss, second-order gains. Without rows, or with one class, the base rate alone is kept."""
    n, width, inner = len(x), x.shape[1] if x.ndim == 2 else 0, 2**depth - 1
    share = (float(y.sum()) + 0.5) / (n + 1)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    score, found = np.full(n, model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            sums = [np.bincount(at, np.repeat(w, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for w in (g, h)]
            left_g, left_h = (s[:, :, :-1] for s in sums)
            all_g, all_h = (s[:, :, -1:] for s in sums)
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < 0.5) | (all_h - left_h < 0.5)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaves = node - inner
        value = -rate * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + l2)
        score += value[leaves]
        found.append((feature, threshold, value))
    return Trees(model.base, *(np.array(part) for part in zip(*found)))
