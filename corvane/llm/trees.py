"""Histogram trees in numpy: boosted (logistic loss) and bagged, as flat arrays of complete binary trees.

Training takes a bounded sample on the driver; scoring walks all trees of a batch at once:
``at = 2 * at + 1 + (x > threshold)`` for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a node that does not split sends all left
    value: np.ndarray  # (trees, leaves)
    base: float
    mean: bool  # average of leaves, else logistic of base plus their sum

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros(0)
        x = np.nan_to_num(x, posinf=1e300, neginf=-1e300)
        inner = self.feature.shape[1]
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
                if at[0] >= inner:
                    break
            total += v[at - inner]
        if self.mean:
            return total / max(1, len(self.value))
        return 1 / (1 + np.exp(-(self.base + total)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], cuts, method="lower")) for j in range(x.shape[1])]


def _grow(xb, grad, hess, edges, bins, depth, l2, least, use):
    """One tree by levels; histograms of all nodes of a level come from one weighted count."""
    n, width = xb.shape
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(n, dtype=np.int64)
    flat = xb[:, use].astype(np.int64) + np.arange(len(use)) * bins
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        key = (flat + (node * len(use) * bins)[:, None]).ravel()
        shape = (nodes, len(use), bins)
        g = np.bincount(key, np.repeat(grad, len(use)), nodes * len(use) * bins).reshape(shape).cumsum(2)
        h = np.bincount(key, np.repeat(hess, len(use)), nodes * len(use) * bins).reshape(shape).cumsum(2)
        ga, ha = g[:, :1, -1:], h[:, :1, -1:]
        gain = g**2 / (h + l2) + (ga - g) ** 2 / (ha - h + l2) - ga**2 / (ha + l2)
        gain[(h < least) | (ha - h < least)] = -1
        best = gain.reshape(nodes, -1).argmax(1)
        f, b = use[best // bins], best % bins
        ok = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
        split = np.where(ok, b, bins)
        feature[first : first + nodes] = f
        threshold[first : first + nodes] = [edges[j][k] if s and k < len(edges[j]) else np.inf for j, k, s in zip(f, b, ok, strict=True)]
        node = 2 * node + (xb[np.arange(n), f[node]] > split[node])
    gs, hs = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
    return feature, threshold, node, gs, hs


def _binned(x, bins):
    x = np.nan_to_num(np.asarray(x, dtype=np.float64), posinf=1e300, neginf=-1e300)
    edges = _edges(x, bins)
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8), edges


def boost(x, y, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Gradient-boosted trees for labels 0 and 1. One class only gives a constant score; no rows give 0.5."""
    y = np.asarray(y, dtype=np.float64)
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base, False)
    xb, edges = _binned(x, bins)
    raw, fs, ts, vs = np.full(len(y), base), [], [], []
    use = np.arange(xb.shape[1])
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        f, t, node, gs, hs = _grow(xb, y - q, q * (1 - q), edges, bins, depth, l2, least, use)
        v = rate * gs / (hs + l2)
        raw += v[node]
        fs.append(f), ts.append(t), vs.append(v)
    return Trees(np.array(fs), np.array(ts), np.array(vs), base, False)


def forest(x, y, trees: int = 60, depth: int = 7, bins: int = 32, least: float = 2.0, seed: int = 7) -> Trees:
    """Bagged trees on random halves of the features; the score is the mean share of label 1 in the leaves."""
    y = np.asarray(y, dtype=np.float64)
    xb, edges = _binned(x, bins)
    rng = np.random.default_rng(seed)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        w = rng.poisson(1.0, len(y)).astype(np.float64)
        use = np.sort(rng.choice(xb.shape[1], max(2, (xb.shape[1] + 1) // 2), replace=False))
        f, t, _, gs, hs = _grow(xb, w * y, w, edges, bins, depth, 1e-6, least, use)
        fs.append(f), ts.append(t), vs.append((gs + y.mean() * 1e-3) / (hs + 1e-3))
    return Trees(np.array(fs), np.array(ts), np.array(vs), 0.0, True)
