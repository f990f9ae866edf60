"""Linear models out of sums: each needs only n, the sums and the products of features and target.

One pass over the data gives these for every year; sums of years are training sets, so an expanding window
costs no further pass. A feature matrix of P columns is P * P numbers a year, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Products of (1, features, target) with themselves."""

    m: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.m + other.m)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    @property
    def x_mean(self) -> np.ndarray:
        return self.m[0, 1:-1] / self.n

    @property
    def y_mean(self) -> float:
        return float(self.m[0, -1] / self.n)

    @property
    def xx(self) -> np.ndarray:
        """Centred products of the features."""
        return self.m[1:-1, 1:-1] - self.n * np.outer(self.x_mean, self.x_mean)

    @property
    def xy(self) -> np.ndarray:
        return self.m[1:-1, -1] - self.n * self.x_mean * self.y_mean

    @property
    def yy(self) -> float:
        return float(self.m[-1, -1] - self.n * self.y_mean**2)

    def squared_error(self, intercept: float, beta: np.ndarray) -> float:
        b = np.concatenate([[intercept], beta, [-1.0]])
        return float(b @ self.m @ b)

    def of(self, columns: list[int]) -> Moments:
        """Moments with some of the features only."""
        at = [0, *(c + 1 for c in columns), len(self.m) - 1]
        return Moments(self.m[np.ix_(at, at)])


def yearly_moments(panel: DataFrame, features: list[str], target: str = "ret_exc") -> dict[int, Moments]:
    """Moments of each calendar year. Tasks add up their own rows, cells of the upper triangles meet in an aggregate
    with partial sums, and what reaches the driver is one triangle a year."""
    width = len(features) + 2
    complete = panel.dropna(subset=[*features, target]).select(F.year("date").alias("year"), *[F.col(c).cast("double").alias(c) for c in [*features, target]])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            years, x = pdf["year"].to_numpy(), pdf.iloc[:, 1:].to_numpy(float)
            x = np.column_stack([np.ones(len(x)), x])
            for y in np.unique(years):
                part = x[years == y]
                held[int(y)] = held.get(int(y), 0) + part.T @ part
        for y, m in held.items():
            yield pd.DataFrame({"year": y, "cell": np.arange(len(upper[0])), "v": m[upper]})

    upper = np.triu_indices(width)
    cells = complete.mapInPandas(partial, "year int, cell int, v double").groupBy("year", "cell").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for y, part in cells.groupby("year"):
        m = np.zeros((width, width))
        m[upper[0][part["cell"]], upper[1][part["cell"]]] = part["v"]
        out[int(y)] = Moments(m + np.triu(m, 1).T)
    return out


Fit = tuple[float, np.ndarray]


def _with_intercept(m: Moments, beta: np.ndarray) -> Fit:
    return float(m.y_mean - m.x_mean @ beta), beta


def ols(m: Moments) -> Fit:
    return _with_intercept(m, np.linalg.pinv(m.xx, hermitian=True) @ m.xy)


def pcr(m: Moments, components: int) -> Fit:
    """Regression on the leading principal components of the centred features."""
    values, vectors = np.linalg.eigh(m.xx)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    v = vectors[:, order]
    return _with_intercept(m, v @ ((v.T @ m.xy) / values[order]))


def pls(m: Moments, components: int) -> Fit:
    """Partial least squares for one target, its recursion run on products instead of rows."""
    xx, xy = m.xx, m.xy.copy()
    w, p, q = [], [], []
    for _ in range(components):
        norm = np.linalg.norm(xy)
        if norm < 1e-12 * max(np.linalg.norm(m.xy), 1e-300):
            break
        weight = xy / norm
        # Deflation of X is carried in the rotation r, so that scores are X r and xx need not change.
        r = weight.copy()
        for k in range(len(w)):
            r -= (p[k] @ weight) * w[k]
        tt = float(r @ xx @ r)
        if tt <= 0:
            break
        load, qk = xx @ r / tt, float(r @ m.xy) / tt
        w.append(r)
        p.append(load)
        q.append(qk)
        xy = xy - load * qk * tt
    return _with_intercept(m, sum((qk * r for qk, r in zip(q, w, strict=True)), np.zeros(len(m.xy))))


def elastic_net(m: Moments, alpha: float, l1_ratio: float, rounds: int = 2000, tolerance: float = 1e-10) -> Fit:
    """Coordinate descent on (1/2n)|y - Xb|^2 + alpha (l1 |b|_1 + (1 - l1)/2 |b|^2)."""
    a, c = m.xx / m.n, m.xy / m.n
    beta, l1, l2 = np.zeros(len(c)), alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(c)):
            rest = c[j] - a[j] @ beta + a[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (a[j, j] + l2) if a[j, j] + l2 > 0 else 0.0
            most = max(most, abs(new - beta[j]))
            beta[j] = new
        if most < tolerance:
            break
    return _with_intercept(m, beta)


def lasso(m: Moments, alpha: float) -> Fit:
    return elastic_net(m, alpha, 1.0)


def out_of_sample_r2(test: Moments, fit: Fit, bench: float) -> float:
    """1 - squared errors over those of a constant, from the test set's sums."""
    base = test.squared_error(bench, np.zeros(len(fit[1])))
    return 1 - test.squared_error(*fit) / base if base > 0 else float("nan")
