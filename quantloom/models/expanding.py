"""Model registry, hold-out selection and yearly expanding-window predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.models import moments as M
from quantloom.models.moments import Fit, Moments

COMPONENTS = (3, 5, 10, 20, 50)
ALPHAS = (0.001, 0.01, 0.1)
L1_RATIOS = (0.1, 0.5, 0.9)
SMALL = ("me", "bm", "mom12m")


@dataclass(frozen=True)
class Linear:
    """A linear model: its fit from moments, and the parameters to choose from."""

    fit: Callable[..., Fit]
    grid: Callable[[int], list[dict]] = lambda p: [{}]
    only: tuple[str, ...] = ()


LINEAR: dict[str, Linear] = {
    "ols3": Linear(M.ols, only=SMALL),
    "ols_all": Linear(M.ols),
    "pcr": Linear(M.pcr, lambda p: [{"components": k} for k in COMPONENTS if k < p] or [{"components": p}]),
    "pls": Linear(M.pls, lambda p: [{"components": k} for k in COMPONENTS if k < p] or [{"components": p}]),
    "enet": Linear(M.elastic_net, lambda p: [{"alpha": a, "l1_ratio": r} for a in ALPHAS for r in L1_RATIOS]),
    "glm": Linear(M.lasso, lambda p: [{"alpha": a} for a in ALPHAS]),
}


def total(years: dict[int, Moments], first: int, last: int) -> Moments | None:
    parts = [m for y, m in years.items() if first <= y <= last]
    return sum(parts[1:], parts[0]) if parts else None


def select(name: str, train: Moments, hold_out: Moments, features: int) -> tuple[dict, list[tuple[dict, float]]]:
    """The parameters with the best hold-out R2 against the training mean, the first among equals, and all scores."""
    best, best_r2, scores = {}, -np.inf, []
    for params in LINEAR[name].grid(features):
        r2 = M.out_of_sample_r2(hold_out, LINEAR[name].fit(train, **params), train.y_mean)
        scores.append((params, r2))
        if r2 > best_r2:
            best, best_r2 = params, r2
    return best, scores


@dataclass
class Run:
    """Fits for every model and test year, and the manifest of what they were trained on."""

    features: list[str]
    bench: float
    fits: dict[tuple[str, int], Fit] = field(default_factory=dict)
    manifest: list[dict] = field(default_factory=list)


def expanding(panel: DataFrame, features: list[str], hold_out_from: int, test_from: int, test_to: int, models: list[str] | None = None, target: str = "ret_exc") -> Run:
    """Fits every model on all years before each test year; parameters are chosen on the hold-out years once."""
    models = models or list(LINEAR)
    unknown = [m for m in models if m not in LINEAR]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    years = M.yearly_moments(panel, features, target)
    early, late = total(years, 0, hold_out_from - 1), total(years, hold_out_from, test_from - 1)
    before = total(years, 0, test_from - 1)
    run = Run(features, before.y_mean if before else float("nan"))
    for name in models:
        columns = [features.index(c) for c in LINEAR[name].only if c in features] if LINEAR[name].only else list(range(len(features)))
        if not columns:
            continue
        params, _ = select(name, early.of(columns), late.of(columns), len(columns)) if early and late else (LINEAR[name].grid(len(columns))[0], [])
        for year in range(test_from, test_to + 1):
            train = total(years, 0, year - 1)
            if train is None or year not in years:
                continue
            intercept, beta = LINEAR[name].fit(train.of(columns), **params)
            full = np.zeros(len(features))
            full[columns] = beta
            run.fits[name, year] = (intercept, full)
            run.manifest.append({"model": name, "year": year, "n_train": int(train.n), "n_test": int(years[year].n), "params": str(params), "status": "done"})
    return run


def predictions(panel: DataFrame, run: Run, target: str = "ret_exc") -> DataFrame:
    """permno, date, model, pred_ret and the target for every fitted model and year.

    Coefficients, a few numbers for each model and year, are broadcast; a prediction is a sum of products."""
    spark = panel.sparkSession
    rows = [(m, y, i, b.tolist()) for (m, y), (i, b) in sorted(run.fits.items())]
    fits = spark.createDataFrame(rows, "model string, ql_year int, ql_intercept double, ql_beta array<double>")
    x = F.array(*[F.col(c).cast("double") for c in run.features])
    joined = panel.select("permno", "date", target, F.year("date").alias("ql_year"), x.alias("ql_x")).join(F.broadcast(fits), "ql_year")
    dot = F.aggregate(F.zip_with("ql_x", "ql_beta", lambda a, b: a * b), F.col("ql_intercept"), lambda s, v: s + v)
    return joined.select("permno", "date", "model", dot.alias("pred_ret"), target)


def completed_years(preds: DataFrame, panel: DataFrame, models: list[str]) -> DataFrame:
    """Years for which every model has as many rows as the panel."""
    want = panel.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    have = preds.filter(F.col("model").isin(*models)).groupBy("model", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return have.join(want, ["year", "n"]).groupBy("year").agg(F.countDistinct("model").alias("done")).filter(F.col("done") == len(set(models))).select("year")


def ensemble(preds: DataFrame) -> DataFrame:
    """Mean prediction over the seeds of each model."""
    return preds.groupBy("permno", "date", "model").agg(F.avg("pred_ret").alias("pred_ret"))
