"""Gradient-boosted trees on dense features, and isotonic calibration, in numpy.

For bounded samples on the driver; the fitted model is a few small arrays that
score any number of rows.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Complete trees of one depth on quantile bins, fitted to the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        bins = self._bin(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        inner = (1 << self.depth) - 1
        slot = bins + np.arange(width) * BINS
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, feature, cut = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                key = ((node - first)[:, None] * (width * BINS) + slot).ravel()
                size = count * width * BINS
                sums = [np.bincount(key, np.repeat(v, width), size).reshape(count, width, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
                gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                gain[(nl < self.least) | (na - nl < self.least)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                for i, b in enumerate(best):
                    if gain.reshape(count, -1)[i, b] > 1e-9:
                        feature[first + i], cut[first + i] = divmod(int(b), BINS)
                node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
            at = node - inner
            leaf = self.rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + self.ridge)
            raw += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, rows, raw = self._bin(x), np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            raw += leaf[node - len(cut)]
        return raw


class Isotonic:
    """The non-decreasing steps nearest to the labels (pool adjacent violators)."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for value, label in zip(x[order], y[order], strict=True):
            blocks.append([float(label), 1.0, float(value)])
            while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
                total, weight, upto = blocks.pop()
                blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, upto]
        self.upto = np.array([b[2] for b in blocks])
        # Each step is drawn a little towards the mean, so that no small step claims certainty.
        mean = y.mean()
        self.value = np.array([(b[0] + mean) / (b[1] + 1) for b in blocks])
        self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.minimum(np.searchsorted(self.upto, x, "left"), len(self.value) - 1)]
