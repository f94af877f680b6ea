"""Small boosted trees on bounded training sets: logistic loss, binned features, calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Trees of fixed depth as flat arrays; ``predict`` gives calibrated probabilities."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    leaf_l2: float = 1.0
    least_rows: int = 5
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.bias, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            self.trees.append(self._tree(x, binned, edges, p - y, p * (1 - p)))
            raw += self._leaves(self.trees[-1], x)
        return self

    def _tree(self, x, binned, edges, g, h):
        inner, size = (1 << self.depth) - 1, x.shape[1]
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = (1e-9, 0, np.inf)
            if len(here) >= 2 * self.least_rows:
                total_g, total_h = g[here].sum(), h[here].sum()
                for f in range(size):
                    if not len(edges[f]):
                        continue
                    b = binned[here, f]
                    left_g = np.cumsum(np.bincount(b, g[here], len(edges[f]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[here], len(edges[f]) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
                    gain = left_g**2 / (left_h + self.leaf_l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.leaf_l2) - total_g**2 / (total_h + self.leaf_l2)
                    gain[(left_n < self.least_rows) | (len(here) - left_n < self.least_rows)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(edges[f][k]))
            _, feature[at], limit[at] = best
            node[here] = 2 * at + 1 + (x[here, feature[at]] > limit[at])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.leaf_l2) * self.rate
        return feature, limit, value

    def _leaves(self, tree, x):
        feature, limit, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += self._leaves(tree, x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit the two numbers of a logistic curve from margins to probabilities on rows that were not trained on."""
        m, (a, b) = self.margin(x), (1.0, 0.0)
        for _ in range(50):  # Newton steps, with a small ridge for separable data
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p)
            grad = np.array([((p - y) * m).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
            hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale = (float(a), float(b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -700, 700)))
