"""Runs from raw tables to reports: panel, training with append and resume, evaluation, periods, costs, small panel."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.models import expanding, nets, trees
from quantloom.operators import costs, metrics, panel, portfolio, subperiods
from quantloom.operators.checkpoints import cut
from quantloom.sources import sinks

#: Tree models, by what makes one, and the parameters to choose from.
GROWN = {"rf": (trees.forest, [{"depth": d} for d in trees.DEPTHS_FOREST]), "gbrt": (trees.boosted, [{"depth": d, "rate": r} for r in trees.RATES for d in trees.DEPTHS_BOOSTED])}
Predict = Callable[[int], DataFrame]


def _linear(p: DataFrame, features: list[str], names: list[str], hold_out_from: int, test_from: int, test_to: int) -> dict[str, Predict]:
    """All linear models share one pass over the panel."""
    run = expanding.expanding(p, features, hold_out_from, test_from, test_to, names) if names else None

    def of(name: str) -> Predict:
        return lambda year: expanding.predictions(p, expanding.Run(run.features, run.bench, {k: v for k, v in run.fits.items() if k == (name, year)}))

    return {n: of(n) for n in names}


def _grown(p: DataFrame, features: list[str], name: str, hold_out_from: int, test_from: int) -> Predict:
    """Trees: parameters are chosen once, on the hold-out years."""
    make, grid = GROWN[name]
    best = trees.select(p, features, make, grid, hold_out_from, test_from)[0]
    return lambda year: trees.expanding(p, features, name, lambda: make(**best), year, year)


def _net(p: DataFrame, features: list[str], name: str) -> Predict:
    return lambda year: nets.predictions(p, features, int(name[2:]), year)


def predictors(p: DataFrame, features: list[str], models: list[str], hold_out_from: int, test_from: int, test_to: int) -> dict[str, Predict]:
    """For each model what predicts a test year from all years before; the registry of all models."""
    unknown = [m for m in models if m not in subperiods.MODEL_ORDER]
    if unknown:
        raise ValueError(f"unknown models: {unknown}; there are {list(subperiods.MODEL_ORDER)}")
    linear = _linear(p, features, [m for m in models if m in expanding.LINEAR], hold_out_from, test_from, test_to)
    return {m: linear[m] if m in linear else _grown(p, features, m, hold_out_from, test_from) if m in ("rf", "gbrt") else _net(p, features, m) for m in models}


def pretest_mean(p: DataFrame, test_from: int, target: str = "ret_exc") -> DataFrame:
    """Mean target before the first test year, the benchmark of the pooled fit."""
    return p.filter(F.year("date") < test_from).agg(F.avg(target).alias("bench"))


def train(p: DataFrame, path: str, models: list[str], hold_out_from: int, test_from: int, test_to: int, append: bool = False, resume: bool = False, features: list[str] | None = None) -> list[int]:
    """Writes predictions to path by model and year and a manifest beside them; returns the years that were trained.

    Without append all earlier predictions go. With it other models' stay, and with resume, too, the years that all
    the given models have finished are left alone. A year is written as soon as it is done."""
    features = features or panel.feature_columns(p)
    spark, known = p.sparkSession, p.dropna(subset=["ret_exc"])
    years = [r["year"] for r in known.select(F.year("date").alias("year")).filter(F.col("year").between(test_from, test_to)).distinct().orderBy("year").collect()]
    done: set[int] = set()
    if append and resume:
        old = _existing(spark, path)
        done = {r["year"] for r in expanding.completed_years(old, known.select("permno", "date"), models).collect()} if old is not None else set()
    todo, first = [y for y in years if y not in done], not append
    if not todo:
        return []
    predict = predictors(p, features, models, hold_out_from, test_from, test_to)
    bench = pretest_mean(p, test_from).first()["bench"]
    for year in todo:
        for name in models:
            sinks.checkpoint_predictions(predict[name](year).select("permno", "date", "model", "pred_ret"), path, whole=first)
            first = False
            row = [(name, year, bench, len(features), "done")]
            sinks.manifest(spark.createDataFrame(row, "model string, year int, pre_test_mean_ret double, n_features int, status string"), f"{path}_manifest/model={name}/year={year}")
    return todo


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).drop("year")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def with_returns(preds: DataFrame, p: DataFrame) -> DataFrame:
    return preds.select("permno", "date", "model", "pred_ret").join(p.select("permno", "date", "ret_exc"), ["permno", "date"], "left")


def evaluate(preds: DataFrame, p: DataFrame, sizes: DataFrame, factors: DataFrame, bench: float, out: str | None = None, audited: bool = False) -> dict[str, DataFrame]:
    """Pooled fit, rank correlations, dispersion and performance of each model; as CSV under out, if given.

    audited: without the months in which a model predicts one value for all."""
    df = with_returns(preds, p)
    df = subperiods.without_degenerate(df) if audited else df
    ls = portfolio.long_short(portfolio.build_portfolios(df, sizes))
    tables = {
        "eval_oos_r2": metrics.pooled_r2(df, bench),
        "eval_ic_stats": metrics.ic_stats(metrics.monthly_ic(df)),
        "eval_pred_std": metrics.dispersion(df),
        "eval_portfolio_perf": portfolio.performance(ls, factors),
    }
    return _written({k: v.withColumn("ord", subperiods.report_place(F.col("model"))) for k, v in tables.items()}, out)


def _written(tables: dict[str, DataFrame], out: str | None) -> dict[str, DataFrame]:
    for name, df in tables.items() if out else ():
        sinks.csv(df, f"{out}/{name}")
    return tables


def evaluate_periods(preds: DataFrame, p: DataFrame, sizes: DataFrame, factors: DataFrame, periods: list[tuple[str, str, str]], bench: float, out: str | None = None) -> dict[str, DataFrame]:
    """Metrics by model and period, and the best model of each period by fit and by Sharpe ratio."""
    tables = subperiods.period_metrics(with_returns(preds, p), sizes, factors, subperiods.period_table(preds.sparkSession, periods), bench)
    best = [subperiods.best_by_period(tables[t], c).select("period", F.lit(c).alias("by"), "model", F.col(c).alias("value")) for t, c in (("oos_r2", "oos_r2"), ("portfolio_perf", "sharpe"))]
    return _written({f"periods_{k}": v for k, v in tables.items()} | {"periods_best": best[0].unionByName(best[1])}, out)


def evaluate_costs(preds: DataFrame, p: DataFrame, details: DataFrame, factors: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """Monthly net returns and their summary under both spreads."""
    held = costs.with_spreads(cut(costs.holdings(with_returns(preds, p), details)))
    monthly = cut(costs.monthly_costs(held, {"fixed": "spread_bps_fixed", "amihud": "spread_bps_amihud"}))
    return _written({"tc_monthly": monthly, "tc_summary": costs.cost_summary(monthly, factors)}, out)


def importance(p: DataFrame, features: list[str], hold_out_from: int, test_from: int) -> DataFrame:
    """Importance of every feature in a forest of depth 2, by all rows of the hold-out years before the first test year."""
    year, known = F.year("date"), p.dropna(subset=["ret_exc"])
    model = trees.forest(2).fit(trees.vectors(known.filter(year < hold_out_from), features))
    hold = known.filter((year >= hold_out_from) & (year < test_from))
    return trees.permutation_importance(model, hold, features, hold.agg(F.avg("ret_exc")).first()[0])


def small_panel(p: DataFrame, hold_out_from: int, test_from: int, out: str | None = None, features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The panel with the allowed features of most importance, and their names; both written under out, if given."""
    ranked = [r["feature"] for r in importance(p, features or panel.feature_columns(p), hold_out_from, test_from).orderBy("place").collect()]  # one row for each feature
    chosen = trees.small_set(ranked)
    small = p.select("permno", "date", "ret_exc", *chosen)
    if out:
        sinks.parquet(small, f"{out}/features_parsimonious")
        sinks.manifest(p.sparkSession.createDataFrame([(chosen,)], "selected_features array<string>"), f"{out}/selected_features")
    return small, chosen


def compare(full: DataFrame, small: DataFrame) -> DataFrame:
    """Fit of each model on both panels, and the difference; models of either."""
    a, b = full.select("model", F.col("oos_r2").alias("r2_full")), small.select("model", F.col("oos_r2").alias("r2_reduced"))
    return a.join(b, "model", "full").withColumn("delta", F.col("r2_reduced") - F.col("r2_full"))


def all_predictions(p: DataFrame, features: list[str], models: list[str], hold_out_from: int, test_from: int, test_to: int) -> DataFrame:
    """Predictions of several models for all test years, as one plan."""
    predict = predictors(p, features, models, hold_out_from, test_from, test_to)
    return reduce(DataFrame.unionByName, [predict[m](y).select("permno", "date", "model", "pred_ret") for m in models for y in range(test_from, test_to + 1)])
