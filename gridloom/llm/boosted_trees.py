"""Histogram gradient boosting for two classes, small enough to train on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges of one feature; a value goes to the bin searchsorted(edges, value, 'left')."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Complete binary trees of ``depth`` levels: feature and threshold of each inner node, a value for each leaf."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    ridge: float = 1.0
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """An empty sample, or one of a single class, gives the constant of the smoothed class share."""
        self.trees = []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        self.edges = [quantile_edges(x[:, j], self.bins) if len(y) else np.empty(0) for j in range(x.shape[1])]
        if len(y) == 0 or y.min() == y.max():
            return self
        b, score = self._binned(x), np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree, leaf = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.iinfo(np.int32).max)
        node, width = np.zeros(len(g), int), self.bins + 1
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for j in range(b.shape[1]):
                at = (node - first) * width + b[:, j]
                gl = np.cumsum(np.bincount(at, g, n * width).reshape(n, width), axis=1)
                hl = np.cumsum(np.bincount(at, h, n * width).reshape(n, width), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                c = gain.argmax(axis=1)
                better = gain[np.arange(n), c] > best
                best = np.where(better, gain[np.arange(n), c], best)
                feature[first : first + n][better], cut[first : first + n][better] = j, c[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
        return (feature, cut, value), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        out = np.full(len(x), self.start)
        if self.trees:
            b, rows = self._binned(x), np.arange(len(x))
            for feature, cut, value in self.trees:
                node = np.zeros(len(x), int)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
                out += value[node - len(feature)]
        return sigmoid(out)
