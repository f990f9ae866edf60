"""Gradient boosted trees for two classes, in numpy, with Platt scaling on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    min_rows: int = 5
    penalty: float = 1.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Second-order boosting on quantile bins; complete trees of fixed depth, so a leaf is a bit pattern."""
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = node == k
                    if rows.sum() < 2 * self.min_rows:
                        continue
                    best = 1e-9
                    for j, c in enumerate(cuts):
                        gs = np.cumsum(np.bincount(codes[rows, j], g[rows], len(c) + 1))
                        hs = np.cumsum(np.bincount(codes[rows, j], h[rows], len(c) + 1))
                        ns = np.cumsum(np.bincount(codes[rows, j], minlength=len(c) + 1))
                        gain = gs**2 / (hs + self.penalty) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.penalty) - gs[-1] ** 2 / (hs[-1] + self.penalty)
                        gain[(ns < self.min_rows) | (ns[-1] - ns < self.min_rows)] = 0
                        if len(c) and gain[:-1].max(initial=0) > best:
                            best, feature[k], cut[k] = gain[:-1].max(), j, c[int(gain[:-1].argmax())]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.penalty)
            self.trees.append((feature, cut, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Boosted:
        """Platt scaling by Newton steps on rows that the trees have not seen."""
        s, (a, b) = self.raw(x), self.platt
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - target) * s).sum(), (p - target).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.platt = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest calibrated probability from which all higher ones reach the precision; 1.01 if none does."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((hit >= precision) & np.append(p[order][1:] < p[order][:-1], True))
    return float(p[order][good[-1]]) if len(good) else 1.01
