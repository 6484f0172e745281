"""Gradient-boosted trees for binary labels, in numpy: histogram splits, logistic loss, level-wise growth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostedTrees:
    """Complete binary trees: ``feature``/``cut`` per inner node ``[trees, 2**depth - 1]``, ``leaf`` per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 4.0) -> BoostedTrees:
    """Deterministic: every row and feature is used in every tree."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = bins + 1
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            best_gain, best_feature, best_bin = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, -1)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = at * width + code[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(1)
                v = gain[np.arange(count), k]
                up = v > best_gain
                best_gain[up], best_feature[up], best_bin[up] = v[up], j, k[up]
            for c in range(count):
                if best_bin[c] >= 0:
                    features[t, first + c], cuts[t, first + c] = best_feature[c], edges[best_feature[c]][best_bin[c]]
            f = features[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > cuts[t, node])
        at = node - inner
        gl, hl = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaves[t] = -rate * gl / (hl + ridge)
        score += leaves[t][at]
    return BoostedTrees(features, cuts, leaves, base)
