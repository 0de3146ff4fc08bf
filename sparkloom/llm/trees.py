"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting of complete trees of a fixed depth."""

    rounds: int = 120
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    penalty: float = 1.0
    least_weight: float = 0.5
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        self.trees = []
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        b = self._binned(x)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Split features, split bins and leaf values; node k has children 2k+1 and 2k+2."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, self.bins + 1)
        node = np.zeros(len(g), int)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            own = node - first
            best = np.full(n, 1e-9)
            for j in range(b.shape[1]):
                key = own * (self.bins + 1) + b[:, j]
                gs = np.bincount(key, g, n * (self.bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(key, h, n * (self.bins + 1)).reshape(n, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hs < self.least_weight) | (ht - hs < self.least_weight)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better] = j
                cut[first : first + n][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return (feature, cut, self.rate * gs / (hs + self.penalty)), leaf

    def decision(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = [(at, s / n) for s, n, a, b in blocks for at in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
