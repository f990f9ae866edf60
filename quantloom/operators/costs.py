"""Signed holdings, spreads, turnover and net returns of long-short portfolios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import at_least, nonzero, ratio
from quantloom.functions.windows import quantile_bucket
from quantloom.operators.diagnostics import exact_quantiles
from quantloom.operators.joins import require_known
from quantloom.operators.portfolio import factor_alpha

SMALL_BPS, MIDDLE_BPS, LARGE_BPS = 20.0, 10.0, 5.0


#: What a holding must be known by.
REQUIRED = ["me_lag1", "exchcd", "ret", "prc", "vol"]


def holdings(preds: DataFrame, details: DataFrame, buckets: int = 10) -> DataFrame:
    """First and last bucket with weights by market value, half of the gross on each side.

    Buckets are cut among the predictions of which all of REQUIRED is known and the market value positive. A
    prediction without a realised return fails the query."""
    known = details.select("permno", F.last_day("date").alias("date"), *REQUIRED).dropna(subset=REQUIRED).filter("me_lag1 > 0")
    whole, side = Window.partitionBy("model", "date"), Window.partitionBy("model", "date", "decile")
    held = require_known(preds, ["ret_exc"]).join(known, ["permno", "date"])
    out = held.withColumn("decile", quantile_bucket(whole.orderBy("pred_ret", "permno"), whole, buckets)).filter(F.col("decile").isin(1, buckets))
    share = F.col("me_lag1") / F.sum("me_lag1").over(side)
    signed = F.when(F.col("decile") == buckets, 0.5 * share).otherwise(-0.5 * share)
    return out.withColumn("signed_w", signed).withColumn("abs_w", F.abs("signed_w"))


def _illiquidity() -> Column:
    return ratio(F.abs("ret"), nonzero(F.abs("prc") * F.col("vol")))


def with_spreads(held: DataFrame) -> DataFrame:
    """held with both spreads. All that a date's rows say together comes from one aggregate by date.

    fixed: by size against the main exchange's quintile points of the date, of all holdings where it has none.
    amihud: by the root of return per dollar traded, cut at the date's 99th percentile; unknown ones take the date's
    median, then that of all."""
    points = lambda c: F.percentile(c, F.array(F.lit(0.2), F.lit(0.8)))
    raw = held.withColumn("ql_illiq", _illiquidity())
    by_date = raw.groupBy("date").agg(
        points(F.when(F.col("exchcd") == 1, F.col("me_lag1"))).alias("ql_own"),
        points(F.col("me_lag1")).alias("ql_every"),
        F.percentile("ql_illiq", F.array(F.lit(0.5), F.lit(0.99))).alias("ql_cuts"),
        F.min("ql_illiq").alias("ql_low"),
        F.count("ql_illiq").alias("ql_n"),
    )
    top = F.col("ql_cuts")[1]
    # The cut reaches the median only where it lies between two values.
    middle = F.when(F.col("ql_n") == 2, (F.col("ql_low") + top) / 2).otherwise(F.col("ql_cuts")[0])
    dates = by_date.select("date", F.coalesce("ql_own", "ql_every").alias("ql_sizes"), top.alias("ql_top"), middle.alias("ql_middle"))
    joined = raw.join(F.broadcast(dates), "date").withColumn("ql_illiq", F.when(F.col("ql_illiq").isNotNull(), F.least("ql_illiq", "ql_top")))
    every = exact_quantiles(joined, ["ql_illiq"], [0.5]).select(F.col("q")[0].alias("ql_all"))
    size = F.col("me_lag1")
    fixed = F.when(size <= F.col("ql_sizes")[0], SMALL_BPS).when(size >= F.col("ql_sizes")[1], LARGE_BPS).otherwise(MIDDLE_BPS)
    bps = at_least(20000.0 * F.sqrt(F.coalesce("ql_illiq", "ql_middle", "ql_all")), 1.0)
    out = joined.join(F.broadcast(every), F.lit(True), "left").withColumn("spread_bps_fixed", fixed).withColumn("spread_bps_amihud", F.when(bps.isNotNull(), F.least(bps, F.lit(300.0))))
    return out.drop("ql_illiq", "ql_sizes", "ql_top", "ql_middle", "ql_all")


def turnover(held: DataFrame) -> DataFrame:
    """Half the absolute change of weights since the model's last date, entries and exits included; 0 at first.

    Each weight counts once at its date and once, negated, at the model's next one, so a sum by date and
    entity gives the changes without an outer join."""
    dates = held.select("model", "date").distinct().withColumn("i", F.row_number().over(Window.partitionBy("model").orderBy("date")))
    now = held.join(F.broadcast(dates), ["model", "date"]).select("model", "permno", "i", "signed_w")
    both = now.unionByName(now.select("model", "permno", (F.col("i") + 1).alias("i"), (-F.col("signed_w")).alias("signed_w")))
    moved = both.groupBy("model", "i", "permno").agg(F.sum("signed_w").alias("d")).groupBy("model", "i").agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    return dates.join(moved, ["model", "i"]).select("model", "date", F.when(F.col("i") == 1, 0.0).otherwise(F.col("turnover")).alias("turnover"))


def monthly_costs(held: DataFrame, spreads: dict[str, str]) -> DataFrame:
    """Gross return, mean spread, turnover, cost and net return of each model and date, for each method.

    spreads: the spread column of each method. Returns and turnover are worked out once for all methods."""
    weighted = {m: (F.sum(F.col("abs_w") * F.col(c)) / F.sum("abs_w")).alias(f"ql_{m}") for m, c in spreads.items()}
    gross = held.groupBy("model", "date").agg(F.coalesce(F.sum(F.col("signed_w") * F.col("ret_exc")), F.lit(0.0)).alias("gross_ls_ret"), *weighted.values())
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("tc_method"), F.col(f"ql_{m}").alias("avg_one_way_spread_bps")) for m in spreads]))
    out = gross.join(turnover(held), ["model", "date"]).withColumn("ql_each", each).select("model", "date", "gross_ls_ret", "turnover", "ql_each.*")
    out = out.withColumn("tc_cost", F.col("turnover") * F.col("avg_one_way_spread_bps") / 10000.0)
    return out.withColumn("net_ls_ret", F.col("gross_ls_ret") - F.col("tc_cost"))


def cost_summary(monthly: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Gross and net performance by method and model, with dense ranks of both Sharpe ratios and their change."""
    by = ["tc_method", "model"]
    series = [(f"{k}_ls_ret", k) for k in ("gross", "net")]
    yearly = [x for c, k in series for x in ((F.avg(c) * 12).alias(f"ann_ret_{k}"), (F.stddev_samp(c) * math.sqrt(12)).alias(f"ann_vol_{k}"))]
    out = monthly.groupBy(*by).agg(F.countDistinct("date").alias("n_months"), F.avg("turnover").alias("mean_turnover"), F.avg("avg_one_way_spread_bps").alias("mean_spread_bps"), F.avg("tc_cost").alias("mean_tc_cost_monthly"), *yearly)
    for _, k in series:
        out = out.withColumn(f"sharpe_{k}", ratio(F.col(f"ann_ret_{k}"), nonzero(F.col(f"ann_vol_{k}"))))
    out = out.withColumn("sharpe_delta", F.col("sharpe_net") - F.col("sharpe_gross"))
    if factors is not None:
        long = monthly.unpivot([*by, "date"], ["gross_ls_ret", "net_ls_ret"], "ql_series", "ql_ret")
        alphas = factor_alpha(long, factors, [*by, "ql_series"], "ql_ret")
        of = lambda c, k: F.max(F.when(F.col("ql_series") == f"{k}_ls_ret", F.col(c))).alias(f"{c}_{k}")
        out = out.join(alphas.groupBy(*by).agg(*[of(c, k) for k in ("gross", "net") for c in ("alpha_annual", "t_alpha")]), by, "left")
    for k in ("gross", "net"):
        out = out.withColumn(f"rank_{k}", F.dense_rank().over(Window.partitionBy("tc_method").orderBy(F.desc_nulls_last(f"sharpe_{k}"))))
    return out.withColumn("rank_change", F.col("rank_net") - F.col("rank_gross"))
