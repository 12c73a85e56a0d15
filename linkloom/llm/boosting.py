"""Gradient-boosted trees on a bounded training table, and isotonic calibration. Training needs numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: for each tree, feature and threshold of inner nodes (heap order) and leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the log loss over quantile bins. Deterministic; no row or feature sampling."""
    n, k = x.shape
    rate_of_one = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(1) for j in range(k)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], axis=1) if n else np.zeros((0, k), np.int64)
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            best = 1e-6
            if len(mine) >= 2 * least:
                gs, hs = g[mine].sum(), h[mine].sum()
                for j in range(k):
                    m = len(edges[j]) + 1
                    c = code[mine, j]
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, m))[:-1] for w in (g[mine], h[mine], None))
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < least) | (len(mine) - nl < least)] = 0
                    if len(gain) and gain.max() > best:
                        best, i = gain.max(), int(gain.argmax())
                        feature[t, at], threshold[t, at] = j, edges[j][i]
            node[mine] = 2 * at + 1 + (x[mine, feature[t, at]] > threshold[t, at])
        end = node - inner
        gs, hs = np.bincount(end, g, inner + 1), np.bincount(end, h, inner + 1)
        leaf[t] = -rate * gs / (hs + l2)
        margin += leaf[t][end]
    return Trees(base, feature, threshold, leaf)


@dataclass(frozen=True)
class Isotonic:
    """A rising curve through the centres of the pooled blocks; straight between them, so that ranks survive."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators. prior: pseudo-observations of the mean in each end block, to keep it off 0 and 1."""
    if not len(y):
        return Isotonic(np.array([-30.0, 30.0]), 1 / (1 + np.exp(np.array([30.0, -30.0]))))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1.0, v, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + m2]
    mean = float(y.mean())
    w, s, m = np.array(blocks).T
    value = np.maximum.accumulate((s + prior * mean) / (w + prior))
    at = m / w
    # a gentle slope beyond the outer blocks keeps the order of extreme margins
    at = np.r_[at[0] - 10, at, at[-1] + 10]
    value = np.r_[value[0] * 0.5, value, 1 - (1 - value[-1]) * 0.5]
    return Isotonic(at, value)
