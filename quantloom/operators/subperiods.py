"""Evaluation over overlapping periods, and models whose predictions do not vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.exprs import month_number
from quantloom.operators.joins import first_by, full_grid
from quantloom.operators.metrics import fit_r2, ic_stats, monthly_ic
from quantloom.operators.portfolio import annualised, build_portfolios, factor_alpha, long_short

#: Models in the order of reports, and those whose predictions are constant throughout.
MODEL_ORDER = ("ols3", "ols_all", "pcr", "pls", "enet", "glm", "rf", "gbrt", "nn1", "nn2", "nn3", "nn4", "nn5")
FULLY_EXCLUDED = ("nn4", "nn5")


def period_table(spark: SparkSession, periods: list[tuple[str, str, str]]) -> DataFrame:
    """period, from_date, to_date and the order in which they were given."""
    rows = [(i, p, a, b) for i, (p, a, b) in enumerate(periods)]
    return spark.createDataFrame(rows, "ord int, period string, a string, b string").select("ord", "period", F.col("a").cast("date").alias("from_date"), F.col("b").cast("date").alias("to_date"))


def last_common_month(a: DataFrame, b: DataFrame) -> DataFrame:
    """The earlier of both tables' last months."""
    ends = a.agg(F.max(F.last_day("date")).alias("end")).unionByName(b.agg(F.max(F.last_day("date")).alias("end")))
    return ends.agg(F.min("end").alias("end"))


def constant_months(preds: DataFrame) -> DataFrame:
    """Model and date pairs of several rows with one prediction for all."""
    return preds.groupBy("model", "date").agg(F.count("pred_ret").alias("n"), F.min("pred_ret").alias("a"), F.max("pred_ret").alias("b")).filter("n > 1 and a = b").select("model", "date")


def without_degenerate(preds: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Predictions without the excluded models and without the months in which a model predicts one value for all."""
    kept = preds.filter(~F.col("model").isin(*excluded)) if excluded else preds
    return kept.join(constant_months(kept), ["model", "date"], "left_anti")


def by_period(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Each row once for every period that holds its date; periods may overlap."""
    p = F.broadcast(periods)
    return rows.join(p, rows["date"].between(p["from_date"], p["to_date"])).drop("from_date", "to_date", "ord")


def period_r2(preds: DataFrame, periods: DataFrame, bench: Column | float) -> DataFrame:
    """R2 of every model and period; NULL where a model has no rows."""
    r2 = by_period(preds, periods).groupBy("model", "period").agg(fit_r2(bench).alias("oos_r2"), F.countDistinct("date").alias("n_months"))
    return full_grid(preds, "model", periods.select("period", "ord")).join(r2, ["model", "period"], "left")


def report_place(model: Column, order: tuple[str, ...] = MODEL_ORDER) -> Column:
    """Place of a model in reports, from 1; unknown models come after all others."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), model)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


def period_ic(preds: DataFrame, periods: DataFrame) -> DataFrame:
    """Mean and deviation of the monthly rank correlations of each model and period."""
    return ic_stats(by_period(monthly_ic(preds), periods), "model", "period")


def period_performance(preds: DataFrame, sizes: DataFrame, factors: DataFrame, periods: DataFrame) -> DataFrame:
    """Long-short return, Sharpe ratio and factor alpha of each model and period. Buckets are cut month by month, so
    a month's return is worked out once, whatever the number of periods that hold it."""
    returns = by_period(long_short(build_portfolios(preds, sizes)), periods)
    return annualised(returns, ["model", "period"]).join(factor_alpha(returns, factors, ["model", "period"]), ["model", "period"], "left")


def period_metrics(preds: DataFrame, sizes: DataFrame, factors: DataFrame, periods: DataFrame, bench: float, excluded: tuple[str, ...] = FULLY_EXCLUDED) -> dict[str, DataFrame]:
    """The tables oos_r2, ic_stats and portfolio_perf by model and period, of predictions that vary."""
    sound = without_degenerate(preds, excluded)
    return {"oos_r2": period_r2(sound, periods, bench), "ic_stats": period_ic(sound, periods), "portfolio_perf": period_performance(sound, sizes, factors, periods)}


def best_by_period(table: DataFrame, c: str) -> DataFrame:
    """The model with the greatest known c in each period, the first in reports among equals."""
    return first_by(table.filter(F.col(c).isNotNull()), ["period"], [F.desc(c), report_place(F.col("model")), F.col("model")])


def missing_months(preds: DataFrame, start: str, end: str) -> DataFrame:
    """Model and month pairs that predictions lack between two dates."""
    spark = preds.sparkSession
    months = spark.sql("SELECT last_day(d) AS date FROM (SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE), INTERVAL 1 MONTH)) AS d)", {"a": start, "b": end})
    return full_grid(preds, "model", months).join(preds.select("model", F.last_day("date").alias("date")).distinct(), ["model", "date"], "left_anti")


def is_complete(preds: DataFrame, start: str, end: str) -> bool:
    """Whether a model has each month from start's to end's; months are compared, not days."""
    return missing_months(preds, start, end).isEmpty()


def month_gap(a: Column, b: Column) -> Column:
    return month_number(a) - month_number(b)
