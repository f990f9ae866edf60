"""Quantile portfolios, long-short returns and their performance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import nonzero, ratio
from quantloom.functions.windows import quantile_bucket

LAGS = 12
THREE, FIVE = ("mkt_rf", "smb", "hml"), ("mkt_rf", "smb", "hml", "rmw", "cma")


def assign_buckets(preds: DataFrame, sizes: DataFrame, buckets: int = 10) -> DataFrame:
    """Predictions with a positive last market value and their bucket within model and date; ties go by permno."""
    held = preds.join(sizes.select("permno", F.last_day("date").alias("date"), "me_lag1"), ["permno", "date"]).filter("me_lag1 > 0")
    whole = Window.partitionBy("model", "date")
    return held.withColumn("decile", quantile_bucket(whole.orderBy("pred_ret", "permno"), whole, buckets))


def bucket_returns(assigned: DataFrame) -> DataFrame:
    """Value-weighted return of each bucket; an unknown return adds nothing, but its weight counts."""
    return assigned.groupBy("model", "date", "decile").agg(
        (F.coalesce(F.sum(F.col("me_lag1") * F.col("ret_exc")), F.lit(0.0)) / F.sum("me_lag1")).alias("port_ret"), F.count(F.lit(1)).alias("n_stocks"), F.sum("me_lag1").alias("total_me")
    )


def build_portfolios(preds: DataFrame, sizes: DataFrame, buckets: int = 10) -> DataFrame:
    return bucket_returns(assign_buckets(preds, sizes, buckets))


def long_short(returns: DataFrame) -> DataFrame:
    """Highest bucket of all against the first, on dates that have both."""
    top = returns.agg(F.max("decile").alias("top"))
    both = returns.join(F.broadcast(top), F.lit(True)).groupBy("model", "date").agg(
        F.max(F.when(F.col("decile") == F.col("top"), F.col("port_ret"))).alias("long_ret"), F.max(F.when(F.col("decile") == 1, F.col("port_ret"))).alias("short_ret")
    )
    return both.dropna(subset=["long_ret", "short_ret"]).withColumn("ls_ret", F.col("long_ret") - F.col("short_ret"))


def annualised(df: DataFrame, by: list[str], c: str = "ls_ret") -> DataFrame:
    """Mean and deviation of a monthly series by the year, and their ratio."""
    out = df.groupBy(*by).agg((F.avg(c) * 12).alias("ann_ret"), (F.stddev_samp(c) * math.sqrt(12)).alias("ann_vol"), F.count(c).alias("n_months"))
    return out.withColumn("sharpe", ratio(F.col("ann_ret"), nonzero(F.col("ann_vol"))))


def hac_regression(y: np.ndarray, x: np.ndarray, lags: int = LAGS) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of y on x and the standard errors that allow for autocorrelation up to lags (Bartlett weights)."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for k in range(1, min(lags, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))


def factor_alpha(returns: DataFrame, factors: DataFrame, by: list[str], c: str = "ls_ret", model: str = "ff5", lags: int = LAGS, align: str = "reference") -> DataFrame:
    """Annual alpha with its t and p of each series over the factors of its date.

    model: ff3 or ff5; without any rmw the former stands in. align: "realised" takes the factors of the month
    after, which is the one that the return of a prediction falls in."""
    if model not in ("ff3", "ff5"):
        raise ValueError(f"unknown factor model {model}")
    if align not in ("reference", "realised"):
        raise ValueError(f"unknown alignment {align}")
    month = F.last_day("date") if align == "reference" else F.last_day(F.add_months("date", 1))
    known = factors.select(F.last_day("date").alias("ql_month"), *FIVE)
    joined = returns.withColumn("ql_month", month).join(F.broadcast(known), "ql_month").select(*by, "date", F.col(c).alias("ql_y"), *FIVE)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        names = list(THREE if model == "ff3" or pdf["rmw"].isna().all() else FIVE)
        pdf = pdf.dropna(subset=[*names, "ql_y"])
        row = {k: None if pdf.empty else pdf[k].iloc[0] for k in by}
        if len(pdf) <= len(names) + 1:
            return pd.DataFrame([row | {"alpha_annual": None, "t_alpha": None, "p_alpha": None, "n_obs": len(pdf)}]) if not pdf.empty else pd.DataFrame()
        beta, se = hac_regression(pdf["ql_y"].to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)]), lags)
        t = beta[0] / se[0] if se[0] > 0 else float("nan")
        return pd.DataFrame([row | {"alpha_annual": 12 * beta[0], "t_alpha": t, "p_alpha": math.erfc(abs(t) / math.sqrt(2)), "n_obs": len(pdf)}])

    kinds = dict(returns.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", alpha_annual double, t_alpha double, p_alpha double, n_obs long"
    return joined.groupBy(*by).applyInPandas(fit, schema)


def performance(ls: DataFrame, factors: DataFrame, factor_model: str = "ff5") -> DataFrame:
    return annualised(ls, ["model"]).join(factor_alpha(ls, factors, ["model"], model=factor_model), "model", "left")


def cumulative(ls: DataFrame) -> DataFrame:
    """Compound long-short return of each model up to each date."""
    w = Window.partitionBy("model").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ls.select("model", "date", (F.product(1 + F.col("ls_ret")).over(w) - 1).alias("cum_ret"))
