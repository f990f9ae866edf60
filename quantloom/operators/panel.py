"""The merged panel and the ranked feature panel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.characteristics import ALL, FROM_DAYS, FROM_PANEL, MONTHLY, SPEC, characteristics, month_measures, panel_measures
from quantloom.operators.cleaning import clean_annual, clean_monthly, clean_quarterly
from quantloom.operators.joins import asof_join, event_window
from quantloom.operators.linking import attach_links, build_links

KEYS = ("permno", "date")
TARGET = "ret_exc"
#: Writes a result of several steps, or leaves it as a plan.
Keep = Callable[[DataFrame], DataFrame]


def _plan(df: DataFrame) -> DataFrame:
    return df


def merged_panel(raw: dict[str, DataFrame], aside: Keep = _plan) -> DataFrame:
    """Clean monthly rows with a link, and the latest annual and quarterly reports that were public by then.

    aside may write its parts: as one plan, monthly rows and links are planned anew after each of 23 exchanges."""
    monthly = aside(clean_monthly(raw["raw_monthly"], raw["raw_names"], raw["raw_delistings"]))
    links = aside(build_links(raw["raw_names"], raw["raw_security"], aside))
    linked = aside(attach_links(monthly, links))
    annual, quarterly = aside(clean_annual(raw["raw_annual"])), aside(clean_quarterly(raw["raw_quarterly"]))
    with_annual = asof_join(linked, annual, "gvkey", "date", "public_date", [F.desc("datadate")], "a_")
    return asof_join(with_annual, quarterly, "gvkey", "date", "public_date", [F.desc("datadate"), F.desc("fqtr")], "q_")


def announcement_returns(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """permno, rdq, ear: the sum of the three daily returns around the announcement."""
    events = panel.select("permno", F.col("q_rdq").alias("rdq")).filter("rdq is not null").distinct()
    return event_window(events, daily, "permno", "rdq", "date", "ret").select("permno", "rdq", F.round("window_sum", 12).alias("ear"))


def raw_features(raw: dict[str, DataFrame], names: list[str] | None = None, ahead: bool = False, keep: Keep = _plan, aside: Keep = _plan) -> DataFrame:
    """permno, date, ret and the named characteristics (all 94 by default), before ranking; ahead: the next row's
    return, too, as ql_next.

    What comes from daily rows is joined to the panel while that is narrow; all else rests on the panel's own rows
    and is one projection of it, whose wide rows are shuffled once, by date."""
    names = names or ALL
    panel = keep(merged_panel(raw, aside))
    daily = [n for n in (*FROM_DAYS, "ear") if n in names]
    own = {n: c.alias(f"ql_{n}") for n, c in panel_measures().items() if n in names}
    days = ["ql_days"] if own or set(daily) & set(FROM_DAYS) else []
    with_days = panel
    if days:
        measures = month_measures(raw["raw_daily"], raw["raw_market"], aside)
        right = aside(measures.select("permno", "date", *[n for n in FROM_DAYS if n in names], F.lit(True).alias("ql_days")))
        with_days = with_days.join(right, list(KEYS), "left")
    if "ear" in names:
        right = aside(announcement_returns(panel, raw["raw_daily"])).withColumnRenamed("rdq", "q_rdq")
        with_days = with_days.join(right, ["permno", "q_rdq"], "left")
    if daily or days:
        with_days = keep(with_days)
    more = [SPEC.lead(F.col("ret")).alias("ql_next")] if ahead else []
    out = characteristics(with_days, [n for n in names if n in MONTHLY], ["ret", *daily, *days, *own.values(), *more])
    # A month without daily rows has none of the family.
    out = out.select("*", *[F.when(F.col("ql_days"), F.col(f"ql_{n}")).alias(n) for n in own])
    return out.select("permno", "date", "ret", *["ql_next"] * ahead, *names)


def unit_ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks scaled to [-1, 1], as functions.windows.unit_rank has them, of two values at least."""
    _, place, n = np.unique(values, return_inverse=True, return_counts=True)
    average = np.cumsum(n) - n + 1 + (n - 1) / 2
    return (2.0 * (average - 1) / (len(values) - 1) - 1)[place]


def rank_columns(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Columns as ranks within their date, scaled to [-1, 1], unknown ones kept unknown.

    Each date's rows meet once, as they are, in one task: 8 bytes for each firm of the month and column. As rows of
    (date, column, value) they would be several times larger, and shuffled again to become columns."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])

    def rank(table: pa.Table) -> pa.Table:
        out = [table.column(k) for k in keep]
        for c in columns:
            known = table.column(c).is_valid().to_numpy()
            ranks = np.zeros(len(known))
            if known.sum() > 1:
                ranks[known] = unit_ranks(table.column(c).drop_null().to_numpy())
            else:
                known = np.zeros(len(known), bool)
            out.append(pa.array(ranks, mask=~known))
        return pa.table(out, names=[*keep, *columns])

    return wide.groupBy("date").applyInArrow(rank, wide.schema)


def excess_target(df: DataFrame, factors: DataFrame) -> DataFrame:
    """df with the next row's return over the next calendar month's riskless rate; rows without it are dropped."""
    return _excess(df.withColumn("ql_next", SPEC.lead(F.col("ret"))), factors)


def _excess(df: DataFrame, factors: DataFrame) -> DataFrame:
    rf = factors.select(F.last_day("date").alias("ql_month"), "rf")
    ahead = df.withColumn("ql_month", F.last_day(F.add_months("date", 1)))
    return ahead.join(F.broadcast(rf), "ql_month", "left").withColumn(TARGET, F.col("ql_next") - F.col("rf")).drop("ql_next", "ql_month", "rf").dropna(subset=[TARGET])


def feature_panel(raw: dict[str, DataFrame], names: list[str] | None = None, keep: Keep = _plan, aside: Keep = _plan, before: int | None = None) -> DataFrame:
    """permno, date, ranked characteristics with unknown ones at 0, and the target.

    Ranks are among all firms of a month. Only then do rows without a next return go, so that a rank does not
    tell who is there a month later. keep may write the results that this is made from, aside those that stay
    until the next of these (checkpoints.Chain). before: only months before that year, as they are in the whole
    panel; months from then on still give the returns that come next."""
    names = names or ALL
    known = raw_features(raw, names, True, keep, aside)
    known = known if before is None else known.filter(F.year("date") < before)
    ranked = rank_columns(known, names, ["permno", "date", "ql_next"]).fillna(0.0, subset=names)
    return keep(_excess(ranked, raw["raw_factors"]).select("permno", "date", *names, TARGET))


def feature_columns(df: DataFrame) -> list[str]:
    """Features are all columns but the keys and the target."""
    return [c for c in df.columns if c not in (*KEYS, TARGET)]
