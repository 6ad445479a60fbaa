"""Histogram gradient-boosted trees, flattened into arrays for traversal by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature[t, k]`` and ``cut[t, k]`` of inner node k of complete tree t, and its leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 1e-3) -> Forest:
    """Boost the logistic loss. No rows give the score 0.5, one class gives nearly its label."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if not n or len(set(y.tolist())) < 2:
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    raw = np.full(n, base)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            local = node - first
            best = np.full(width, least)
            split = np.full(width, -1)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                at = local * k + codes[:, j]
                g = np.bincount(at, grad, width * k).reshape(width, k)
                h = np.bincount(at, hess, width * k).reshape(width, k)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better] = j
                split[better] = top[better]
                cut[first : first + width][better] = cuts[j][top[better]]
            right = np.zeros(n, bool)
            has = split[local] >= 0
            right[has] = codes[has, feature[node[has]]] > split[local[has]]
            node = 2 * node + 1 + right
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        raw += value[leaf]
        features.append(feature)
        limits.append(cut)
        values.append(value)
    return Forest(np.array(features), np.array(limits), np.array(values), base)
