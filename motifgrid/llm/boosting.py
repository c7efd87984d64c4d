"""Gradient-boosted decision trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Depth-limited regression trees on the logistic loss, with Newton leaf values."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.smooth = rounds, depth, rate, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale = (1.0, 0.0)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(x), np.int64)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            if not len(here):
                continue
            gs, hs = g[here].sum(), h[here].sum()
            leaf[node] = -self.rate * gs / (hs + self.smooth)
            if node >= nodes // 2:
                continue
            best = 1e-6
            for f in range(x.shape[1]):
                order = here[np.argsort(x[here, f], kind="stable")]
                v = x[order, f]
                edge = np.flatnonzero(v[1:] > v[:-1])
                if not len(edge):
                    continue
                gl, hl = np.cumsum(g[order])[edge], np.cumsum(h[order])[edge]
                gain = gl**2 / (hl + self.smooth) + (gs - gl) ** 2 / (hs - hl + self.smooth) - gs**2 / (hs + self.smooth)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], f, (v[edge[k]] + v[edge[k] + 1]) / 2
            if feature[node] >= 0:
                at[here] = 2 * node + 1 + (x[here, feature[node]] > cut[node])
        return feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(f >= 0, down, at)
            out += leaf[at]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        margin = np.zeros(len(x))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            one = self._grow(x, p - y, p * (1 - p))
            self.trees.append(one)
            kept, self.trees = self.trees, [one]
            margin += self.margin(x)
            self.trees = kept
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Platt scaling on rows that weren't learned from."""
        m, a, b = self.margin(x), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * m + b)))
            a -= 0.5 * ((p - y) * m).mean() / max((m**2).mean(), 1e-9)
            b -= 0.5 * (p - y).mean()
        self.scale = (a, b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))
