"""Out-of-sample fit and rank correlation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exprs import nonzero, ratio
from quantloom.functions.windows import average_rank

LEAST_ROWS = 5


def fit_r2(bench: Column | float) -> Column:
    """1 - squared errors over those of the benchmark, in one pass; NULL if a row is incomplete."""
    r, g = F.col("ret_exc"), F.col("pred_ret")
    b = bench if isinstance(bench, Column) else F.lit(bench)
    incomplete = F.max(F.when(r.isNull() | g.isNull(), 1).otherwise(0)) == 1
    return F.when(~incomplete, 1 - ratio(F.sum((r - g) * (r - g)), nonzero(F.sum((r - b) * (r - b)))))


def pooled_r2(preds: DataFrame, bench: float) -> DataFrame:
    return preds.groupBy("model").agg(fit_r2(bench).alias("oos_r2"))


def r2_by_year(preds: DataFrame, bench: float) -> DataFrame:
    return preds.groupBy("model", F.year("date").alias("year")).agg(fit_r2(bench).alias("oos_r2"))


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str, least: int = LEAST_ROWS) -> DataFrame:
    """Spearman correlation of each group of at least least complete rows; NULL where a side is constant."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = known.select(*by, average_rank(F.col(x), *by).alias("rx"), average_rank(F.col(y), *by).alias("ry"))
    varied = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    n, sx, sy = F.count(F.lit(1)), F.sum("rx"), F.sum("ry")
    cov = n * F.sum(F.col("rx") * F.col("ry")) - sx * sy
    spread = (n * F.sum(F.col("rx") * F.col("rx")) - sx * sx) * (n * F.sum(F.col("ry") * F.col("ry")) - sy * sy)
    return ranked.groupBy(*by).agg(n.alias("n"), F.when(varied, ratio(cov, nonzero(F.sqrt(spread)))).alias("ic")).filter(F.col("n") >= least).drop("n")


def monthly_ic(preds: DataFrame) -> DataFrame:
    return rank_correlation(preds, ["model", "date"], "pred_ret", "ret_exc")


def ic_stats(ic: DataFrame, *by: str) -> DataFrame:
    out = ic.groupBy(*(by or ("model",))).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("ic").alias("n_months"))
    return out.withColumn("icir", ratio(F.col("mean_ic"), nonzero(F.col("std_ic"))))


def summary(preds: DataFrame, bench: float) -> DataFrame:
    return pooled_r2(preds, bench).join(ic_stats(monthly_ic(preds)), "model", "left")


def dispersion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model").agg(F.stddev_samp("pred_ret").alias("pred_std"))


def coverage(preds: DataFrame, other: DataFrame) -> DataFrame:
    """Share of each model's rows whose key is in other."""
    hit = preds.join(other.select("permno", "date").distinct().withColumn("ql_hit", F.lit(1)), ["permno", "date"], "left")
    return hit.groupBy("model").agg((F.count("ql_hit") / F.count(F.lit(1))).alias("covered"))
