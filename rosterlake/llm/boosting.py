"""Gradient-boosted trees for two classes, on features in bins, with numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, start in ((self.feature, -1), (self.limit, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(start)
        return len(self.value) - 1


class BoostedTrees:
    """Logistic loss; each tree splits to ``depth`` where the second-order gain is best."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.size, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.trees: list[Tree] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            tree = Tree()
            score += self._grow(tree, binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
        return self

    def _grow(self, tree: Tree, binned, edges, gradient, hessian) -> np.ndarray:
        out = np.zeros(len(gradient))
        open_ = [(tree.add(), np.arange(len(gradient)), 0)]
        while open_:
            node, rows, depth = open_.pop()
            total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
            best = (1e-6, -1, 0)
            if depth < self.depth and len(rows) > 10:
                whole = total_g**2 / (total_h + self.ridge)
                for f, limits in enumerate(edges):
                    if not len(limits):
                        continue
                    own = binned[rows, f]
                    g = np.cumsum(np.bincount(own, gradient[rows], len(limits) + 1))[:-1]
                    h = np.cumsum(np.bincount(own, hessian[rows], len(limits) + 1))[:-1]
                    gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] < 0:
                tree.value[node] = self.rate * total_g / (total_h + self.ridge)
                out[rows] = tree.value[node]
                continue
            _, f, k = best
            tree.feature[node], tree.limit[node] = f, float(edges[f][k])
            less = binned[rows, f] <= k
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            open_ += [(tree.left[node], rows[less], depth + 1), (tree.right[node], rows[~less], depth + 1)]
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            feature, limit = np.array(tree.feature), np.array(tree.limit)
            left, right, value = np.array(tree.left), np.array(tree.right), np.array(tree.value)
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= limit[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            score += value[at]
        return score
