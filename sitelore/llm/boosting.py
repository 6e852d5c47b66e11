"""Gradient boosted trees for two classes, with Platt calibration.

Small on purpose: it is fitted on the driver on a bounded sample, and applied to
arrays inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1: a leaf
    limit: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for part, x in ((self.feature, -1), (self.limit, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                low = x[rows, self.feature[node]] <= self.limit[node]
                todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Boosted:
    """Logistic loss, second-order leaf values, exact splits."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least
        self.base, self.trees, self.scale, self.shift = 0.0, [], 1.0, 0.0

    def _split(self, x, g, h, rows):
        best, sg, sh = (1e-6, -1, 0.0), g[rows].sum(), h[rows].sum()
        own = sg * sg / (sh + self.l2)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            cut = np.flatnonzero(np.diff(v))
            if not len(cut):
                continue
            gl, hl = np.cumsum(g[order])[cut], np.cumsum(h[order])[cut]
            gain = gl * gl / (hl + self.l2) + (sg - gl) ** 2 / (sh - hl + self.l2) - own
            gain[(hl < self.least) | (sh - hl < self.least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        return best

    def _grow(self, tree, x, g, h, rows, depth) -> int:
        node = tree.add()
        _, f, limit = self._split(x, g, h, rows) if depth else (0, -1, 0.0)
        if f < 0:
            tree.value[node] = float(-self.rate * g[rows].sum() / (h[rows].sum() + self.l2))
            return node
        low = x[rows, f] <= limit
        tree.feature[node], tree.limit[node] = f, limit
        tree.left[node] = self._grow(tree, x, g, h, rows[low], depth - 1)
        tree.right[node] = self._grow(tree, x, g, h, rows[~low], depth - 1)
        return node

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for _ in range(self.rounds):
            p = _sigmoid(z)
            tree = Tree()
            self._grow(tree, x, p - y, np.maximum(p * (1 - p), 1e-9), rows, self.depth)
            self.trees.append(tree)
            z = z + tree.predict(x)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that the trees weren't fitted on, by Newton steps with smoothed targets."""
        z, n1, n0 = self.raw(x), float(y.sum()), float((1 - y).sum())
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = np.array([1.0, 0.0])
        m = np.stack([z, np.ones_like(z)], 1)
        for _ in range(50):
            p = _sigmoid(m @ w)
            step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2), m.T @ (p - t))
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = float(w[0]), float(w[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.raw(x) + self.shift)
