"""Gradient-boosted trees with logistic loss, and isotonic calibration, on small dense matrices (NumPy only)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Trees of equal depth stored as arrays: split feature and threshold of each inner node, value of each leaf."""

    depth: int = 4
    trees: int = 120
    rate: float = 0.1
    bins: int = 64
    least: int = 8
    ridge: float = 1.0
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.array([]) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1) if n else np.zeros((0, width), int)
        rate = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.base)
        if n < 2 * self.least or y.min() == y.max():
            return self
        flat = binned + np.arange(width) * self.bins
        for _ in range(self.trees):
            p = _sigmoid(margin)
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (width * self.bins) + flat).ravel()
                size = count * width * self.bins
                g, h, c = (np.bincount(at, np.repeat(w, width), size).reshape(count, width, self.bins).cumsum(axis=2) for w in (grad, hess, np.ones(n)))
                total = [a[:, :, -1:] for a in (g, h, c)]
                gain = g**2 / (h + self.ridge) + (total[0] - g) ** 2 / (total[1] - h + self.ridge) - total[0] ** 2 / (total[1] + self.ridge)
                gain[(c < self.least) | (total[2] - c < self.least)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                for k in range(count):
                    j, b = divmod(int(best[k]), self.bins)
                    if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                        feature[first + k], threshold[first + k] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.value.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out


@dataclass
class Isotonic:
    """Non-decreasing map from margins to probabilities by pooling adjacent violators, linear between block centres."""

    at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    to: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(margin):
            return self
        points, inverse = np.unique(margin, return_inverse=True)
        weight = np.bincount(inverse).astype(float)
        mean = np.bincount(inverse, y) / weight
        blocks: list[list[float]] = []  # mean, weight, sum of margins
        for m, w, x in zip(mean, weight, points, strict=True):
            blocks.append([m, w, x * w])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, x2 = blocks.pop()
                b = blocks[-1]
                blocks[-1] = [(b[0] * b[1] + m2 * w2) / (b[1] + w2), b[1] + w2, b[2] + x2]
        self.at = np.array([x / w for _, w, x in blocks])
        self.to = np.array([m for m, _, _ in blocks])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the plain logistic keeps the order within a flat block."""
        return np.clip(0.999 * np.interp(margin, self.at, self.to) + 0.001 * _sigmoid(margin), 0.0, 1.0)
