"""Links between two firm identifiers: by security number, else by ticker, for the days both were in use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exprs import word_overlap
from quantloom.operators.joins import first_by, open_end, overlap_join

NUMBER_LENGTH = 8
NAME_SIMILARITY = 0.3


def key_text(c: Column) -> Column:
    """Trimmed upper case; empty is missing, and missing matches nothing."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def name_spans(names: DataFrame) -> DataFrame:
    """Name records with a number; the others are not linked, by ticker neither."""
    permco = F.col("permco") if "permco" in names.columns else F.lit(None)
    out = names.select("permno", permco.cast("long").alias("permco"), key_text(F.col("ncusip")).alias("cusip8"), key_text(F.col("ticker")).alias("ticker"), "comnam", "namedt", open_end(F.col("nameendt")).alias("nameendt"))
    return out.filter("cusip8 is not null")


def security_spans(security: DataFrame) -> DataFrame:
    """Securities with a whole number; the others are not linked, by ticker neither."""
    has = lambda c: F.col(c) if c in security.columns else F.lit(None)
    first = F.coalesce(has("first_date").cast("date"), F.lit("1900-01-01").cast("date"))
    out = security.select("gvkey", "iid", F.substring(key_text(F.col("cusip")), 1, NUMBER_LENGTH).alias("cusip8"), key_text(F.col("tic")).alias("ticker"), has("conm").cast("string").alias("conm"), first.alias("sec_start"), open_end(has("last_date").cast("date")).alias("sec_end"))
    return out.filter(F.length("cusip8") == NUMBER_LENGTH)


_OUT = ["permno", "permco", "gvkey", "iid", "cusip8", "link_start", "link_end", "link_method"]


def number_links(names: DataFrame, security: DataFrame, least_days: int = 1) -> DataFrame:
    joined = overlap_join(name_spans(names), security_spans(security).drop("ticker"), "cusip8", ("namedt", "nameendt"), ("sec_start", "sec_end"), least_days)
    return joined.withColumn("link_method", F.lit("cusip")).select(*_OUT)


def ticker_pairs(names: DataFrame, security: DataFrame, matched: DataFrame, least_days: int = 1) -> DataFrame:
    """Names and securities of one ticker in the same days, for entities that no number matched, with the share of
    words that their names have in common (a blank name shares none)."""
    left = name_spans(names).join(matched.select("permno").distinct(), "permno", "left_anti").filter("ticker is not null")
    joined = overlap_join(left.drop("cusip8"), security_spans(security), "ticker", ("namedt", "nameendt"), ("sec_start", "sec_end"), least_days)
    return joined.withColumn("name_sim", F.coalesce(word_overlap(F.col("comnam"), F.col("conm")), F.lit(0.0)))


def _plan(df: DataFrame) -> DataFrame:
    return df


def ticker_links(names: DataFrame, security: DataFrame, matched: DataFrame, least_days: int = 1, aside: Callable[[DataFrame], DataFrame] = _plan) -> DataFrame:
    """Pairs whose names are alike; where no security of the pairs has a name, all of them."""
    pairs = aside(ticker_pairs(names, security, matched, least_days))
    named = pairs.agg(F.coalesce(F.max(F.trim("conm") != ""), F.lit(False)).alias("ql_named"))
    alike = ~F.col("ql_named") | (F.col("name_sim") >= NAME_SIMILARITY)
    return pairs.join(F.broadcast(named), F.lit(True)).filter(alike).withColumn("link_method", F.lit("ticker")).select(*_OUT)


def method_rank(c: Column) -> Column:
    return F.when(c == "cusip", 0).when(c == "ticker", 1).otherwise(2)


def one_link(links: DataFrame) -> DataFrame:
    """For each entity and start one link: by the better method, then the longer one."""
    days = F.datediff("link_end", "link_start")
    return first_by(links, ["permno", "link_start"], [method_rank(F.col("link_method")), days.desc(), F.col("gvkey"), F.col("iid")])


def build_links(names: DataFrame, security: DataFrame, aside: Callable[[DataFrame], DataFrame] = _plan) -> DataFrame:
    """One link for each entity and start. aside may write what is read more than once."""
    by_number = aside(number_links(names, security))
    return one_link(by_number.unionByName(ticker_links(names, security, by_number, aside=aside)))


def links_on(links: DataFrame, permno: int, day: str) -> DataFrame:
    """Links of one entity that hold on a day."""
    return links.filter((F.col("permno") == permno) & F.lit(day).cast("date").between(F.col("link_start"), F.col("link_end")))


def match_rate(names: DataFrame, links: DataFrame) -> DataFrame:
    """Entities, linked ones by method, and the share without a link."""
    best = links.groupBy("permno").agg(F.min(method_rank(F.col("link_method"))).alias("best"))
    per = names.select("permno").distinct().join(best, "permno", "left")
    n = F.count(F.lit(1))
    return per.agg(
        n.alias("n_entities"),
        F.count(F.when(F.col("best") == 0, 1)).alias("n_cusip"),
        F.count(F.when(F.col("best") == 1, 1)).alias("n_ticker"),
        (F.count(F.when(F.col("best").isNull(), 1)) / n).alias("unmatched_share"),
        (F.count(F.when(F.col("best").isNull(), 1)) / n > 0.05).alias("warn"),
    )


def attach_links(monthly: DataFrame, links: DataFrame) -> DataFrame:
    """Monthly rows with the link that holds in their month; of several, the better method, then the longer one."""
    other = links.select(F.col("permno").alias("ql_key"), "gvkey", "iid", "link_method", F.last_day("link_start").alias("ql_from"), F.last_day("link_end").alias("ql_to"), F.datediff("link_end", "link_start").alias("ql_days"))
    left = monthly.withColumn("date", F.last_day("date"))
    joined = left.join(other, (left["permno"] == other["ql_key"]) & left["date"].between(other["ql_from"], other["ql_to"]))
    return first_by(joined, ["permno", "date"], [method_rank(F.col("link_method")), F.desc("ql_days"), F.col("gvkey")]).drop("ql_key", "ql_from", "ql_to", "ql_days")
