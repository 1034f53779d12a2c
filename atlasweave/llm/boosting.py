"""Gradient-boosted trees for two classes on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete trees of one depth: at each inner node a feature and a cut, at each leaf a value."""

    trees: int = 40
    depth: int = 4
    rate: float = 0.3
    ridge: float = 1.0
    base: float = 0.0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            features, cuts = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                split = np.full((n, 2), -1)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    code = (node - first) * (BINS + 1) + binned[:, f]
                    g, h = (np.bincount(code, v, n * (BINS + 1)).reshape(n, -1).cumsum(axis=1) for v in (gradient, weight))
                    left = g[:, :-1] ** 2 / (h[:, :-1] + self.ridge)
                    right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + self.ridge)
                    gain = (left + right - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge))[:, : len(edges[f])]
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(n), at] > best
                    best[better] = gain[better, at[better]]
                    split[better, 0], split[better, 1] = f, at[better]
                for k in range(n):
                    if split[k, 0] >= 0:
                        features[first + k], cuts[first + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), features[node]] >= cuts[node])
            leaf = node - (2**self.depth - 1)
            g, h = (np.bincount(leaf, v, 2**self.depth) for v in (gradient, weight))
            values = self.rate * g / (h + self.ridge)
            self.parts.append((features, cuts, values))
            score += values[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, values in self.parts:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] >= cuts[node])
            score += values[node - (2**self.depth - 1)]
        return score
