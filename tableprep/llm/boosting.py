"""Gradient-boosted trees on few thousand rows, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes by number: column (-1 for a leaf), threshold (left: at most), children, value."""

    column: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for part, empty in ((self.column, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part.append(empty)
        return len(self.column) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        column, threshold = np.array(self.column), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            inner = np.flatnonzero(column[at] >= 0)
            if not len(inner):
                return np.array(self.value)[at]
            node = at[inner]
            at[inner] = np.where(x[inner, column[node]] <= threshold[node], left[node], right[node])


class Boosted:
    """Logistic loss, second-order leaf values (Friedman 2001; Chen and Guestrin 2016)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[Tree] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for column in x.T]
        binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)
        total = np.full(len(y), self.start)
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-total))
            tree = Tree()
            self._grow(tree, binned, cuts, y - chance, chance * (1 - chance), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            total += tree.predict(x)
        return self

    def _grow(self, tree, binned, cuts, pull, curve, rows, depth) -> int:
        node = tree.add()
        g, h = pull[rows].sum(), curve[rows].sum()
        tree.value[node] = float(self.rate * g / (h + self.l2))
        best = (1e-6, -1, 0)
        for c in range(binned.shape[1] if depth and len(rows) >= 2 * self.least else 0):
            bins = binned[rows, c]
            n = len(cuts[c]) + 1
            gl, hl = (np.bincount(bins, weights=w[rows], minlength=n).cumsum()[:-1] for w in (pull, curve))
            nl = np.bincount(bins, minlength=n).cumsum()[:-1]
            gain = gl**2 / (hl + self.l2) + (g - gl) ** 2 / (h - hl + self.l2) - g**2 / (h + self.l2)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), c, int(gain.argmax()))
        if best[1] >= 0:
            _, c, k = best
            goes_left = binned[rows, c] <= k
            tree.column[node], tree.threshold[node] = c, float(cuts[c][k])
            tree.left[node] = self._grow(tree, binned, cuts, pull, curve, rows[goes_left], depth - 1)
            tree.right[node] = self._grow(tree, binned, cuts, pull, curve, rows[~goes_left], depth - 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += tree.predict(x)
        return 1 / (1 + np.exp(-total))
