"""Universe, delistings, market value and publication lags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exprs import nonzero, public_date, ratio
from quantloom.functions.windows import PanelSpec
from quantloom.operators.joins import first_by, interval_join, open_end

SHARE_CODES = (10, 11)
EXCHANGES = (1, 2, 3)
#: Delisting codes whose missing return is imputed, and by what.
PERFORMANCE_CODES = (500, 584)
IMPUTED_RETURN = -0.30
ANNUAL_LAG, QUARTERLY_LAG = 6, 3
SPEC = PanelSpec()


def universe(monthly: DataFrame, names: DataFrame) -> DataFrame:
    """Monthly rows with the name record valid on their date (the latest, if several), of ordinary shares on the main exchanges."""
    spans = names.select("permno", "shrcd", "exchcd", "ncusip", "ticker", "comnam", "namedt", open_end(F.col("nameendt")).alias("nameendt"))
    held = interval_join(monthly, spans, "permno", "date", "namedt", "nameendt", ["permno", "date"], [F.desc("namedt"), F.desc("nameendt")])
    return held.filter(F.col("shrcd").isin(*SHARE_CODES) & F.col("exchcd").isin(*EXCHANGES))


def adjust_delistings(monthly: DataFrame, delistings: DataFrame) -> DataFrame:
    """Returns compounded with the month's delisting return, which is imputed for performance delistings.

    Delistings whose return stays unknown change nothing, and do not repeat the month of another one."""
    dl = F.when(F.col("dlret").isNull() & F.col("dlstcd").between(*PERFORMANCE_CODES), F.lit(IMPUTED_RETURN)).otherwise(F.col("dlret"))
    right = delistings.select("permno", F.last_day("date").alias("ql_month"), dl.alias("ql_dl")).filter("ql_dl is not null")
    joined = monthly.withColumn("ql_month", F.last_day("date")).join(right, ["permno", "ql_month"], "left")
    both = (1 + F.col("ret")) * (1 + F.col("ql_dl")) - 1
    new = F.when(F.col("ql_dl").isNull(), F.col("ret")).when(F.col("ret").isNull(), F.col("ql_dl")).otherwise(both)
    return joined.withColumn("ret", new).drop("ql_month", "ql_dl")


def market_values(monthly: DataFrame) -> DataFrame:
    """me in millions, the split-adjusted price, and the last row's me (the own one on an entity's first row)."""
    me = F.abs("prc") * F.col("shrout") / 1000.0
    out = monthly.withColumn("me", me).withColumn("prc_adj", ratio(F.abs("prc"), nonzero(F.col("cfacshr"))))
    return out.withColumn("me_lag1", F.coalesce(SPEC.lag(F.col("me"), 1), F.col("me")))


def clean_monthly(monthly: DataFrame, names: DataFrame, delistings: DataFrame) -> DataFrame:
    wanted = ["permno", "date", "ret", "retx", "prc", "prc_adj", "shrout", "vol", "cfacshr", "me", "me_lag1", "shrcd", "exchcd"]
    out = market_values(adjust_delistings(universe(monthly, names), delistings))
    return out.select(*[c for c in wanted if c in out.columns])


def clean_reports(reports: DataFrame, lag_months: int, keys: list[str], required: list[str]) -> DataFrame:
    """Reports with their public date, without rows that miss a required column; of equal keys, the last by all columns."""
    known = reports.dropna(subset=required)
    keys = [k for k in keys if k in reports.columns]
    order = [F.desc_nulls_last(c) for c in reports.columns if c not in keys]
    return first_by(known, keys, order).withColumn("public_date", public_date(F.col("datadate"), lag_months))


def clean_annual(reports: DataFrame) -> DataFrame:
    return clean_reports(reports, ANNUAL_LAG, ["gvkey", "datadate"], ["gvkey", "datadate"])


def clean_quarterly(reports: DataFrame) -> DataFrame:
    return clean_reports(reports, QUARTERLY_LAG, ["gvkey", "datadate", "fqtr"], ["gvkey", "datadate"])
