"""Queries by name, over the adapter's inputs, each with the SQL that states it once more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import characteristics as C
from quantloom.functions.exprs import month_number, ratio
from quantloom.functions.windows import PanelSpec, unit_rank
from quantloom.models import expanding, nets, trees
from quantloom.operators import cleaning, costs, diagnostics, joins, linking, metrics, panel, portfolio, subperiods
from quantloom.operators.checkpoints import Chain, cut, release
from quantloom.plans import oracle as O  # noqa: N812
from quantloom.plans import runs
from quantloom.plans.adapter import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SPEC = PanelSpec()
#: Benchmark mean of the pooled fit, and the periods of the sub-period queries.
BENCH = 0.01
PERIODS = [("full", "1996-01-01", "2001-12-31"), ("early", "1996-01-01", "1997-12-31"), ("middle", "1998-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31"), ("empty", "2010-01-01", "2010-12-31")]
HOLD_OUT_FROM, TEST_FROM, TEST_TO = 1998, 2000, 2001
LAYERS = range(1, 6)
LINEAR_FEATURES = ["me", "bm", "mom12m", "mom1m", "turn", "ep", "sp", "agr", "gma", "acc"]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def show(df: DataFrame, keys: list[str], values: list[str] = (), digits: int = 6) -> DataFrame:
    """Keys as they are (dates as text), values rounded."""
    dates = {f.name for f in df.schema.fields if f.dataType.typeName() == "date"}
    cols: list[Column] = [F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in keys]
    return df.select(*cols, *[(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in values])


MERGED = ("raw_monthly", "raw_names", "raw_delistings", "raw_security", "raw_annual", "raw_quarterly")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.merged_panel(tables(spark, sf_dir, *MERGED))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_monthly", "raw_names", "raw_delistings")
    return cleaning.clean_monthly(raw["raw_monthly"], raw["raw_names"], raw["raw_delistings"])


# Scans, filters and scalar rules.
@register(
    "scan_project_filter",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06 AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY ALL",
)
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kept = df.filter(F.col("l_returnflag").isin("A", "R") & F.col("l_discount").between(0.02, 0.06) & (F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1999-01-01"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@register(
    "coerce_number",
    "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS x, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 6) END AS y, round(event_id / nullif(event_id % 4, 0), 6) AS r FROM events",
)
def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.functions.exprs import without_nan
    from quantloom.sources.readers import number

    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    nan = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    out = without_nan(df.select("event_id", number(text).alias("x"), nan.alias("y"), ratio(F.col("event_id").cast("double"), (F.col("event_id") % 4).cast("double")).alias("r")))
    return out.select("event_id", "x", F.round("y", 6).alias("y"), F.round("r", 6).alias("r"))


@register("universe_interval_join", O.sql(f"SELECT permno, {O.text_dates('date')}, shrcd, exchcd FROM chosen"))
def universe_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_monthly", "raw_names")
    return show(cleaning.universe(raw["raw_monthly"], raw["raw_names"]), ["permno", "date", "shrcd", "exchcd"])


@register("delist_adjust", O.sql(f"SELECT permno, {O.text_dates('date')}, {O.rounded(['ret'])} FROM delisted"))
def delist_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_monthly", "raw_names", "raw_delistings")
    return show(cleaning.adjust_delistings(cleaning.universe(raw["raw_monthly"], raw["raw_names"]), raw["raw_delistings"]), ["permno", "date"], ["ret"])


@register("market_cap_lag", O.sql(f"SELECT permno, {O.text_dates('date')}, {O.rounded(['me', 'prc_adj', 'me_lag1'])} FROM clean"))
def market_cap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(clean(spark, sf_dir), ["permno", "date"], ["me", "prc_adj", "me_lag1"])


@register("public_date", O.sql(f"SELECT 'annual' AS kind, gvkey, {O.text_dates('datadate', 'public_date')} FROM annual UNION ALL SELECT 'quarterly', gvkey, {O.text_dates('datadate', 'public_date')} FROM quarterly"))
def public_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_annual", "raw_quarterly")
    both = [f(raw[t]).select(F.lit(k).alias("kind"), "gvkey", "datadate", "public_date") for k, t, f in (("annual", "raw_annual", cleaning.clean_annual), ("quarterly", "raw_quarterly", cleaning.clean_quarterly))]
    return show(both[0].unionByName(both[1]), ["kind", "gvkey", "datadate", "public_date"])


@register("dedup_last", "SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return show(joins.first_by(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]), ["o_custkey", "o_orderkey", "o_orderdate"])


# Links.
@register("link_overlap", O.sql(f"SELECT permno, permco, gvkey, iid, cusip8, {O.text_dates('link_start', 'link_end')}, link_method FROM by_number"))
def link_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_names", "raw_security")
    return show(linking.number_links(raw["raw_names"], raw["raw_security"]), linking._OUT)


@register("ticker_fallback_anti", O.sql(f"SELECT permno, permco, gvkey, iid, cusip8, {O.text_dates('link_start', 'link_end')}, link_method FROM by_ticker"))
def ticker_fallback_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, security = tables(spark, sf_dir, "raw_names", "raw_security").values()
    return show(linking.ticker_links(names, security, linking.number_links(names, security)), linking._OUT)


@register("link_dedup", O.sql(f"SELECT permno, gvkey, {O.text_dates('link_start', 'link_end')}, link_method FROM links"))
def link_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_names", "raw_security")
    return show(linking.build_links(raw["raw_names"], raw["raw_security"]), ["permno", "gvkey", "link_start", "link_end", "link_method"])


@register(
    "match_rate",
    O.sql(
        """SELECT count(*) AS n_entities, count(*) FILTER (best = 0) AS n_cusip, count(*) FILTER (best = 1) AS n_ticker, round(count(*) FILTER (best IS NULL) / count(*), 6) AS unmatched_share, count(*) FILTER (best IS NULL) / count(*) > 0.05 AS warn
        FROM (SELECT DISTINCT permno FROM raw_names) n LEFT JOIN (SELECT permno, min(CASE link_method WHEN 'cusip' THEN 0 ELSE 1 END) AS best FROM links GROUP BY permno) l ON n.permno = l.permno"""
    ),
)
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, security = tables(spark, sf_dir, "raw_names", "raw_security").values()
    return linking.match_rate(names, linking.build_links(names, security)).withColumn("unmatched_share", F.round("unmatched_share", 6))


@register("link_point_lookup", O.sql(f"SELECT permno, gvkey, {O.text_dates('link_start', 'link_end')} FROM links WHERE permno = 7 AND DATE '1998-03-01' BETWEEN link_start AND link_end"))
def link_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_names", "raw_security")
    return show(linking.links_on(linking.build_links(raw["raw_names"], raw["raw_security"]), 7, "1998-03-01"), ["permno", "gvkey", "link_start", "link_end"])


@register("name_jaccard", O.sql("SELECT permno, gvkey, CAST(link_start AS VARCHAR) AS link_start, round(name_sim, 6) AS name_sim FROM by_likeness"))
def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of names for the pairs that a ticker alone connects."""
    names, security = tables(spark, sf_dir, "raw_names", "raw_security").values()
    return show(linking.ticker_pairs(names, security, linking.number_links(names, security)), ["permno", "gvkey", "link_start"], ["name_sim"])


# As-of joins.
_A, _Q = ["a_at", "a_sale", "a_ib"], ["q_atq", "q_ibq", "q_epspxq"]


@register("asof_annual", O.sql(f"SELECT permno, {O.text_dates('date', 'a_datadate', 'a_public_date')}, gvkey, {O.rounded(_A, 4)} FROM merged"))
def asof_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(merged(spark, sf_dir), ["permno", "date", "a_datadate", "a_public_date", "gvkey"], _A, 4)


@register("asof_quarterly", O.sql(f"SELECT permno, {O.text_dates('date', 'q_datadate', 'q_rdq')}, gvkey, {O.rounded(_Q)} FROM merged"))
def asof_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(merged(spark, sf_dir), ["permno", "date", "q_datadate", "q_rdq", "gvkey"], _Q)


O.CTES |= {
    "days": "SELECT permno, date, ret, row_number() OVER (PARTITION BY permno ORDER BY date) AS i FROM raw_daily",
    "news": "SELECT DISTINCT permno, q_rdq AS rdq FROM merged WHERE q_rdq IS NOT NULL",
    "hits": "SELECT n.permno, rdq, i FROM news n ASOF JOIN days t ON n.permno = t.permno AND n.rdq <= t.date",
    "ear": "SELECT h.permno, rdq, round(sum(ret), 12) AS ear FROM hits h JOIN days t ON h.permno = t.permno AND t.i BETWEEN h.i - 1 AND h.i + 1 GROUP BY ALL",
}


@register("asof_forward_event_window", O.sql(f"SELECT permno, {O.text_dates('rdq')}, {O.rounded(['ear'])} FROM ear"))
def asof_forward_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, *MERGED, "raw_daily")
    return show(panel.announcement_returns(panel.merged_panel(raw), raw["raw_daily"]), ["permno", "rdq"], ["ear"])


@register("no_lookahead", O.sql("SELECT CAST(sum(CASE WHEN a_public_date > date OR q_public_date > date THEN 1 ELSE 0 END) AS BIGINT) AS n_future, count(*) AS n FROM merged"))
def no_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("a_public_date") > F.col("date")) | (F.col("q_public_date") > F.col("date"))
    return merged(spark, sf_dir).agg(F.coalesce(F.sum(F.when(late, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_future"), F.count(F.lit(1)).alias("n"))


# Characteristics, family by family.
def _family(name: str) -> None:
    items = [c for c in C.FAMILIES[name] if c in C.HISTORY or c in C.SECTION]

    @register(f"features_{name}", O.sql(f"SELECT permno, {O.text_dates('date')}, {O.rounded(items, 10)} FROM feat_{name}"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(C.characteristics(merged(spark, sf_dir), items), ["permno", "date"], items, 10)


for _name in ("momentum", "value", "profitability", "investment"):
    _family(_name)

_W = "OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"


def _long(c: str) -> str:
    return f"CASE WHEN count({c}) {_W} >= 120 THEN avg({c}) {_W} END"


O.CTES |= {
    "joined_days": "SELECT t.*, vwretd AS m, ret * vwretd AS rm, vwretd * vwretd AS mm, abs(ret) / nullif(abs(prc) * vol, 0) AS illq, CASE WHEN vol = 0 THEN 1.0 ELSE 0.0 END AS still FROM raw_daily t LEFT JOIN raw_market k ON t.date = k.date",
    "betas": f"SELECT *, (({_long('rm')}) - ({_long('ret')}) * ({_long('m')})) / nullif(({_long('mm')}) - ({_long('m')}) * ({_long('m')}), 0) AS beta FROM joined_days",
    "residuals": "SELECT *, ret - beta * m AS e, (ret - beta * m) * (ret - beta * m) AS ee FROM betas",
    "measured": f"""SELECT permno, date, beta, beta * beta AS betasq, CASE WHEN ({_long('ee')}) IS NOT NULL THEN sqrt(greatest(({_long('ee')}) - ({_long('e')}) * ({_long('e')}), 0)) END AS idiovol, {_long('illq')} AS ill,
      round({O.roll('stddev_samp', 'ret', 21, 10)}, 12) AS retvol, {O.roll('max', 'ret', 21, 10)} AS maxret, {O.roll('avg', 'still', 21, 10)} AS zerotrade FROM residuals""",
    "by_month": "SELECT permno, last_day(date) AS date, " + ", ".join(f"max_by({c}, date) FILTER ({c} IS NOT NULL) AS {c}" for c in ("beta", "betasq", "idiovol", "retvol", "maxret", "ill", "zerotrade")) + " FROM measured GROUP BY permno, last_day(date)",
    "cut": "SELECT * REPLACE (CASE WHEN ill IS NOT NULL THEN least(ill, quantile_cont(ill, 0.99) OVER (PARTITION BY date)) END AS ill) FROM by_month",
    "feat_friction": """SELECT c.*, CASE WHEN p.me IS NOT NULL THEN ln(greatest(p.me, 1e-6)) END AS me, datediff('day', p.first, p.date) / 365.25 AS age
      FROM cut c LEFT JOIN (SELECT permno, date, me, min(date) OVER (PARTITION BY permno) AS first FROM merged) p ON c.permno = p.permno AND c.date = p.date""",
}
_FRICTION = [c for c in C.FAMILIES["friction"] if c != "ill"]


@register("features_friction", O.sql(f"SELECT permno, {O.text_dates('date')}, {O.rounded(_FRICTION, 5)}, round(ill * 1e9, 4) + 0.0 AS ill FROM feat_friction"))
def features_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, *MERGED, "raw_daily", "raw_market")
    df = C.friction(panel.merged_panel(raw), raw["raw_daily"], raw["raw_market"])
    measures = [F.round(F.col(c), 5).alias(c) if c != "ill" else F.round(F.col(c) * 1e9, 4).alias(c) for c in C.FAMILIES["friction"]]
    return show(df.select("permno", "date", *measures), ["permno", "date"], C.FAMILIES["friction"])


@register("month_last_nonnull", O.sql(f"SELECT permno, CAST(last_day(date) AS VARCHAR) AS date, {O.rounded(['x'])} FROM (SELECT permno, last_day(date) AS date, max_by(nullif(vol, 0), date) FILTER (vol <> 0) AS x FROM raw_daily GROUP BY ALL) t"))
def month_last_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables(spark, sf_dir, "raw_daily")["raw_daily"].withColumn("x", F.nullif(F.col("vol"), F.lit(0.0)))
    return show(C.last_known(daily, ["x"]), ["permno", "date"], ["x"])


# Ranking and the target.
_RANKED = ["mom1m", "turn", "dolvol", "bm", "sp", "gma", "roe", "curr", "tang", "hire"]
O.CTES |= {
    "few": f"SELECT m.permno, m.date, ret, {', '.join(_RANKED)} FROM merged m JOIN feat_momentum a ON m.permno = a.permno AND m.date = a.date JOIN feat_value b ON m.permno = b.permno AND m.date = b.date JOIN feat_profitability c ON m.permno = c.permno AND m.date = c.date JOIN feat_investment e ON m.permno = e.permno AND m.date = e.date",
    "targeted": "SELECT s.*, nxt - rf AS ret_exc FROM (SELECT *, lead(ret) OVER (PARTITION BY permno ORDER BY date) AS nxt FROM few) s JOIN raw_factors f ON f.date = last_day(s.date + INTERVAL 1 MONTH) WHERE nxt IS NOT NULL",
}


@register("rank_normalise", O.sql(f"SELECT permno, {O.text_dates('date')}, " + ", ".join(f"round({O.rank_to_unit(c, 'date')}, 6) + 0.0 AS {c}" for c in _RANKED) + " FROM few"))
def rank_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.characteristics(merged(spark, sf_dir), _RANKED)
    return show(panel.rank_columns(df, _RANKED, ["permno", "date"]), ["permno", "date"], _RANKED)


@register("target_excess", O.sql(f"SELECT permno, {O.text_dates('date')}, {O.rounded(['ret_exc'])} FROM targeted"))
def target_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, *MERGED, "raw_factors")
    return show(panel.excess_target(panel.merged_panel(raw).select("permno", "date", "ret"), raw["raw_factors"]), ["permno", "date"], ["ret_exc"])


def _ranked_sql(names: list[str], source: str) -> str:
    ranks = ", ".join(f"coalesce(round({O.rank_to_unit(c, 'date')}, 6), 0) + 0.0 AS {c}" for c in names)
    ahead = f"SELECT permno, date, {ranks}, lead(ret) OVER (PARTITION BY permno ORDER BY date) AS nxt FROM {source}"
    return O.sql(f"SELECT permno, {O.text_dates('s.date').replace('AS s.date', 'AS date')}, {', '.join(names)}, round(nxt - rf, 6) + 0.0 AS ret_exc FROM ({ahead}) s JOIN raw_factors f ON f.date = last_day(s.date + INTERVAL 1 MONTH) WHERE nxt IS NOT NULL")


@register("feature_panel", _ranked_sql(_RANKED, "few"))
def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, *MERGED, "raw_factors")
    return show(panel.feature_panel(raw, _RANKED), ["permno", "date"], [*_RANKED, "ret_exc"])


_MONTH = [f for f in C.FAMILIES if f != "friction"]
_OWN = {f: [c for c in C.FAMILIES[f] if c != "ear"] for f in C.FAMILIES}
O.CTES |= {
    "every": f"SELECT m.permno, m.date, m.ret, {', '.join(f'{f}.{c}' for f in _OWN for c in _OWN[f])}, ear.ear FROM merged m "
    + " ".join(f"JOIN feat_{f} {f} ON m.permno = {f}.permno AND m.date = {f}.date" for f in _MONTH)
    + " LEFT JOIN feat_friction friction ON m.permno = friction.permno AND m.date = friction.date LEFT JOIN ear ON m.permno = ear.permno AND m.q_rdq = ear.rdq",
}


@register("feature_panel_all", _ranked_sql(C.ALL, "every"))
def feature_panel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 94 characteristics."""
    return show(panel.feature_panel(tables(spark, sf_dir)), ["permno", "date"], [*C.ALL, "ret_exc"])


# Predictions out of plain signals, and what is measured on them.
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals over the clean monthly rows with the target, in long form; one pass over each firm's rows."""
    signals = clean(spark, sf_dir).select("permno", "date", "ret", SPEC.compound(F.col("ret"), 2, 7).alias("mom"), (-F.col("ret")).alias("rev"), (-F.log("me")).alias("size"))
    wide = panel.excess_target(signals, tables(spark, sf_dir, "raw_factors")["raw_factors"]).drop("ret")
    return wide.unpivot(["permno", "date", "ret_exc"], ["mom", "rev", "size"], "model", "pred_ret").dropna(subset=["pred_ret"])


O.CTES |= {
    "signals": f"SELECT permno, date, {O.comp(2, 7)} AS mom, -ret AS rev, -ln(me) AS size, lead(ret) OVER (PARTITION BY permno ORDER BY date) AS nxt FROM clean",
    "wide": "SELECT s.permno, s.date, nxt - rf AS ret_exc, mom, rev, size FROM signals s JOIN raw_factors f ON f.date = last_day(s.date + INTERVAL 1 MONTH) WHERE nxt IS NOT NULL",
    "preds": "SELECT permno, date, ret_exc, model, pred_ret FROM (UNPIVOT wide ON mom, rev, size INTO NAME model VALUE pred_ret)",
    "placed": """SELECT p.*, me_lag1, row_number() OVER w AS r, count(*) OVER (PARTITION BY model, p.date) AS n FROM preds p JOIN clean c ON p.permno = c.permno AND p.date = c.date WHERE me_lag1 > 0
      WINDOW w AS (PARTITION BY model, p.date ORDER BY pred_ret, p.permno)""",
    "assigned": "SELECT * EXCLUDE (r, n), CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) END AS INT) AS decile FROM placed",
    "ports": "SELECT model, date, decile, coalesce(sum(me_lag1 * ret_exc), 0) / sum(me_lag1) AS port_ret, count(*) AS n_stocks, sum(me_lag1) AS total_me FROM assigned GROUP BY ALL",
    "ls": "SELECT a.model, a.date, b.port_ret AS long_ret, a.port_ret AS short_ret, b.port_ret - a.port_ret AS ls_ret FROM ports a JOIN ports b ON a.model = b.model AND a.date = b.date AND a.decile = 1 AND b.decile = 10",
    "months": "SELECT CAST(unnest(generate_series(DATE '1995-07-31', DATE '2001-06-30', INTERVAL 1 MONTH)) AS DATE) AS d",
}


def _r2(extra: str = "") -> str:
    return f"CASE WHEN bool_or(ret_exc IS NULL OR pred_ret IS NULL) THEN NULL ELSE 1 - sum(pow(ret_exc - pred_ret, 2)) / nullif(sum(pow(ret_exc - {BENCH}, 2)), 0) END"


@register("pooled_r2", O.sql(f"SELECT model, round({_r2()}, 6) AS oos_r2 FROM preds GROUP BY model"))
def pooled_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(metrics.pooled_r2(predictions(spark, sf_dir), BENCH), ["model"], ["oos_r2"])


@register("r2_by_year", O.sql(f"SELECT model, year(date) AS year, round({_r2()}, 6) AS oos_r2 FROM preds GROUP BY ALL"))
def r2_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(metrics.r2_by_year(predictions(spark, sf_dir), BENCH).withColumn("year", F.col("year").cast("long")), ["model", "year"], ["oos_r2"])


def _avg_rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


O.CTES |= {
    "ranks": f"SELECT model, date, {_avg_rank('pred_ret', 'model, date')} AS rx, {_avg_rank('ret_exc', 'model, date')} AS ry FROM preds",
    "ic": "SELECT model, date, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM ranks GROUP BY ALL HAVING count(*) >= 5",
}


@register("monthly_ic", O.sql(f"SELECT model, {O.text_dates('date')}, round(ic, 6) + 0.0 AS ic FROM ic"))
def monthly_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(metrics.monthly_ic(predictions(spark, sf_dir)), ["model", "date"], ["ic"])


@register("ic_summary", O.sql(f"SELECT p.model, oos_r2, n_months, round(mean_ic, 6) AS mean_ic, round(std_ic, 6) AS std_ic, round(mean_ic / nullif(std_ic, 0), 6) AS icir FROM (SELECT model, round({_r2()}, 6) AS oos_r2 FROM preds GROUP BY model) p LEFT JOIN (SELECT model, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, count(ic) AS n_months FROM ic GROUP BY model) i ON p.model = i.model"))
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(metrics.summary(predictions(spark, sf_dir), BENCH), ["model", "n_months"], ["oos_r2", "mean_ic", "std_ic", "icir"])


@register("prediction_dispersion", O.sql("SELECT model, round(stddev_samp(pred_ret), 6) AS pred_std FROM preds GROUP BY model"))
def prediction_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(metrics.dispersion(predictions(spark, sf_dir)), ["model"], ["pred_std"])


@register("merge_coverage", O.sql("SELECT p.model, round(count(m.permno) / count(*), 6) AS covered FROM preds p LEFT JOIN (SELECT DISTINCT permno, date FROM linked) m ON p.permno = m.permno AND p.date = m.date GROUP BY p.model"))
def merge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(metrics.coverage(predictions(spark, sf_dir), merged(spark, sf_dir)), ["model"], ["covered"])


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.assign_buckets(predictions(spark, sf_dir), clean(spark, sf_dir))


def ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.long_short(portfolio.bucket_returns(assigned(spark, sf_dir)))


@register("deciles", O.sql(f"SELECT permno, {O.text_dates('date')}, model, decile FROM assigned"))
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(assigned(spark, sf_dir), ["permno", "date", "model", "decile"])


@register("vw_deciles", O.sql(f"SELECT model, {O.text_dates('date')}, decile, n_stocks, {O.rounded(['port_ret', 'total_me'])} FROM ports"))
def vw_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(portfolio.bucket_returns(assigned(spark, sf_dir)), ["model", "date", "decile", "n_stocks"], ["port_ret", "total_me"])


@register("long_short", O.sql(f"SELECT model, {O.text_dates('date')}, {O.rounded(['long_ret', 'short_ret', 'ls_ret'])} FROM ls"))
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(ls(spark, sf_dir), ["model", "date"], ["long_ret", "short_ret", "ls_ret"])


_ANN = "avg({0}) * 12 AS ann_ret{1}, stddev_samp({0}) * sqrt(12) AS ann_vol{1}, avg({0}) * 12 / nullif(stddev_samp({0}) * sqrt(12), 0) AS sharpe{1}"


@register("ls_performance", O.sql(f"SELECT model, n_months, {O.rounded(['ann_ret', 'ann_vol', 'sharpe'])} FROM (SELECT model, count(ls_ret) AS n_months, {_ANN.format('ls_ret', '')} FROM ls GROUP BY model) t"))
def ls_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(portfolio.annualised(ls(spark, sf_dir), ["model"]), ["model", "n_months"], ["ann_ret", "ann_vol", "sharpe"])


@register("cumulative_ls", O.sql(f"SELECT model, {O.text_dates('date')}, round(product(1 + ls_ret) OVER (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS cum_ret FROM ls"))
def cumulative_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(portfolio.cumulative(ls(spark, sf_dir)), ["model", "date"], ["cum_ret"])


_FACTORS = list(portfolio.FIVE)


def _alpha_ctes(name: str, series: str, by: list[str], y: str) -> str:
    """Puts CTEs that regress y on a constant and the factors of its month, and names the one with alpha, t and p.

    The factors are taken out of y and of the constant one by one; what is left of the constant weighs the errors,
    whose products up to twelve months apart make the variance. p is an integral of the normal density."""
    p = f"OVER (PARTITION BY {', '.join(by)})"
    keys = ", ".join(f"s.{k}" for k in by)
    O.CTES[f"{name}_0"] = f"SELECT {keys}, s.date, s.{y} AS y, 1.0 AS one, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _FACTORS)} FROM {series} s JOIN raw_factors f ON last_day(s.date) = last_day(f.date) WHERE s.{y} IS NOT NULL"
    for i, f in enumerate(_FACTORS):
        rest = ["y", "one", *_FACTORS[i + 1 :]]
        O.CTES[f"{name}_{i + 1}"] = f"SELECT {', '.join(by)}, date, {', '.join(f'{c} - sum({c} * {f}) {p} / sum({f} * {f}) {p} * {f} AS {c}' for c in rest)} FROM {name}_{i}"
    O.CTES[f"{name}_fit"] = f"SELECT {', '.join(by)}, date, one, sum(one * y) {p} / sum(one * one) {p} AS alpha, one * (y - sum(one * y) {p} / sum(one * one) {p} * one) / sum(one * one) {p} AS psi, row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY date) AS i, count(*) {p} AS n_obs FROM {name}_{len(_FACTORS)}"
    same = " AND ".join(f"a.{k} = b.{k}" for k in by)
    O.CTES[f"{name}_var"] = f"SELECT {', '.join(f'a.{k}' for k in by)}, any_value(a.alpha) AS alpha, any_value(a.n_obs) AS n_obs, sum(a.psi * b.psi * (1 - abs(a.i - b.i) / 13.0)) AS v FROM {name}_fit a JOIN {name}_fit b ON {same} AND abs(a.i - b.i) <= 12 GROUP BY ALL"
    O.CTES[f"{name}_t"] = f"SELECT {', '.join(by)}, n_obs, CASE WHEN n_obs > 6 THEN 12 * alpha END AS alpha_annual, CASE WHEN n_obs > 6 THEN alpha / sqrt(v) END AS t_alpha FROM {name}_var"
    area = "list_sum(list_transform(range(0, 401), lambda k: (CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(k * abs(t_alpha) / 400, 2) / 2))) * abs(t_alpha) / 1200"
    O.CTES[f"{name}_alpha"] = f"SELECT *, greatest(1 - sqrt(2 / pi()) * {area}, 0) AS p_alpha FROM {name}_t"
    return f"{name}_alpha"


_LS_ALPHA = _alpha_ctes("ls_reg", "ls", ["model"], "ls_ret")
_PERF = ["ann_ret", "ann_vol", "sharpe", "alpha_annual", "t_alpha", "p_alpha"]


@register("hac_alpha", O.sql(f"SELECT t.model, n_months, n_obs, {O.rounded(_PERF, 5)} FROM (SELECT model, count(ls_ret) AS n_months, {_ANN.format('ls_ret', '')} FROM ls GROUP BY model) t LEFT JOIN {_LS_ALPHA} a ON t.model = a.model"))
def hac_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha over five factors with errors robust to autocorrelation."""
    factors = tables(spark, sf_dir, "raw_factors")["raw_factors"]
    return show(portfolio.performance(ls(spark, sf_dir), factors), ["model", "n_months", "n_obs"], _PERF, 5)


@register("market_beta_alpha", O.sql("SELECT model, round(regr_slope(ls_ret, mkt_rf), 6) AS slope, round(12 * regr_intercept(ls_ret, mkt_rf), 6) AS alpha_annual FROM ls JOIN raw_factors f ON ls.date = f.date GROUP BY model"))
def market_beta_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = tables(spark, sf_dir, "raw_factors")["raw_factors"].select("date", "mkt_rf")
    joined = ls(spark, sf_dir).join(F.broadcast(factors), "date").groupBy("model")
    return show(joined.agg(F.regr_slope("ls_ret", "mkt_rf").alias("slope"), (12 * F.regr_intercept("ls_ret", "mkt_rf")).alias("alpha_annual")), ["model"], ["slope", "alpha_annual"])


# Sub-periods.
O.CTES |= {
    "constant": "SELECT model, date FROM preds GROUP BY ALL HAVING count(pred_ret) > 1 AND min(pred_ret) = max(pred_ret)",
    "sound": "SELECT f.* FROM preds f ANTI JOIN constant c ON f.model = c.model AND f.date = c.date",
    "periods": " UNION ALL ".join(f"SELECT '{p}' AS period, DATE '{a}' AS a, DATE '{b}' AS b" for p, a, b in PERIODS),
    "period_fit": f"SELECT model, period, {_r2()} AS oos_r2, count(DISTINCT date) AS n_months FROM sound JOIN periods ON date BETWEEN a AND b GROUP BY ALL",
    "period_grid": "SELECT model, period, oos_r2, n_months FROM (SELECT DISTINCT model FROM sound) CROSS JOIN periods LEFT JOIN period_fit USING (model, period)",
    "period_ics": "SELECT model, period, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, count(ic) AS n_months FROM ic JOIN periods ON date BETWEEN a AND b GROUP BY ALL",
    "period_ls": "SELECT model, period, date, ls_ret FROM ls JOIN periods ON date BETWEEN a AND b",
    "period_perf": f"SELECT model, period, count(ls_ret) AS n_months, {_ANN.format('ls_ret', '')} FROM period_ls GROUP BY ALL",
}
_PERIOD_ALPHA = _alpha_ctes("period_reg", "period_ls", ["model", "period"], "ls_ret")


@register("zero_var_months", O.sql(f"SELECT model, {O.text_dates('date')} FROM constant"))
def zero_var_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(subperiods.constant_months(predictions(spark, sf_dir)), ["model", "date"])


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subperiods.period_r2(subperiods.without_degenerate(predictions(spark, sf_dir)), subperiods.period_table(spark, PERIODS), BENCH)


@register("model_period_grid", O.sql("SELECT model, period, n_months, round(oos_r2, 6) AS oos_r2 FROM period_grid"))
def model_period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_grid(spark, sf_dir), ["model", "period", "n_months"], ["oos_r2"])


_BEST = "round({0}, 6) AS {0} FROM {1} WHERE {0} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY period ORDER BY {0} DESC, model) = 1"


@register("best_per_period", O.sql("SELECT period, model, " + _BEST.format("oos_r2", "period_grid")))
def best_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(subperiods.best_by_period(_grid(spark, sf_dir), "oos_r2"), ["period", "model"], ["oos_r2"])


def _period_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    periods = subperiods.period_table(spark, PERIODS)
    return subperiods.period_metrics(predictions(spark, sf_dir), clean(spark, sf_dir), tables(spark, sf_dir, "raw_factors")["raw_factors"], periods, BENCH)


@register("period_ic", O.sql("SELECT model, period, n_months, round(mean_ic, 6) AS mean_ic, round(std_ic, 6) AS std_ic, round(mean_ic / nullif(std_ic, 0), 6) AS icir FROM period_ics"))
def period_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_period_tables(spark, sf_dir)["ic_stats"], ["model", "period", "n_months"], ["mean_ic", "std_ic", "icir"])


@register("period_performance", O.sql(f"SELECT t.model, t.period, n_months, n_obs, {O.rounded(_PERF, 5)} FROM period_perf t LEFT JOIN {_PERIOD_ALPHA} a ON t.model = a.model AND t.period = a.period"))
def period_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return, Sharpe ratio and alpha of each model in each period."""
    return show(_period_tables(spark, sf_dir)["portfolio_perf"], ["model", "period", "n_months", "n_obs"], _PERF, 5)


@register("best_sharpe_per_period", O.sql("SELECT period, model, " + _BEST.format("sharpe", "period_perf")))
def best_sharpe_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(subperiods.best_by_period(_period_tables(spark, sf_dir)["portfolio_perf"], "sharpe"), ["period", "model"], ["sharpe"])


@register("report_order", O.sql("SELECT period, model, n_months, CAST(coalesce(list_position(['" + "', '".join(subperiods.MODEL_ORDER) + f"'], model), {len(subperiods.MODEL_ORDER) + 1}) AS INT) AS ord FROM period_grid"))
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_grid(spark, sf_dir).withColumn("place", subperiods.report_place(F.col("model"))).drop("ord").withColumnRenamed("place", "ord"), ["period", "model", "n_months", "ord"])


@register("pivot_periods", O.sql("SELECT model, " + ", ".join(f"round(max(oos_r2) FILTER (period = '{p}'), 6) AS \"{p}\"" for p, *_ in PERIODS) + " FROM period_grid GROUP BY model"))
def pivot_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [p for p, *_ in PERIODS]
    return show(_grid(spark, sf_dir).groupBy("model").pivot("period", names).agg(F.first("oos_r2")), ["model"], names)


@register("coverage_except", O.sql("SELECT model, CAST(last_day(d) AS VARCHAR) AS date FROM (SELECT DISTINCT model FROM preds) CROSS JOIN months EXCEPT SELECT model, CAST(date AS VARCHAR) FROM preds"))
def coverage_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(subperiods.missing_months(predictions(spark, sf_dir), "1995-07-31", "2001-06-30"), ["model", "date"])


@register("last_common_month", O.sql("SELECT CAST(least((SELECT max(last_day(date)) FROM preds), (SELECT max(last_day(date)) FROM raw_daily)) AS VARCHAR) AS \"end\""))
def last_common_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(subperiods.last_common_month(predictions(spark, sf_dir), tables(spark, sf_dir, "raw_daily")["raw_daily"]), ["end"])


# Trading costs.
O.CTES |= {
    "eligible": """SELECT p.*, c.me_lag1, exchcd, ret, prc, vol, row_number() OVER w AS r, count(*) OVER (PARTITION BY model, p.date) AS n FROM preds p JOIN clean c ON p.permno = c.permno AND p.date = c.date
      WHERE c.me_lag1 > 0 AND exchcd IS NOT NULL AND ret IS NOT NULL AND prc IS NOT NULL AND vol IS NOT NULL WINDOW w AS (PARTITION BY model, p.date ORDER BY pred_ret, p.permno)""",
    "held": """SELECT *, CASE WHEN decile = 10 THEN 0.5 ELSE -0.5 END * me_lag1 / sum(me_lag1) OVER (PARTITION BY model, date, decile) AS signed_w
      FROM (SELECT * EXCLUDE (r, n), CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) END AS INT) AS decile FROM eligible) e WHERE decile IN (1, 10)""",
    "points": "SELECT date, quantile_cont(me_lag1, 0.2) FILTER (exchcd = 1) AS p20, quantile_cont(me_lag1, 0.8) FILTER (exchcd = 1) AS p80, quantile_cont(me_lag1, 0.2) AS q20, quantile_cont(me_lag1, 0.8) AS q80 FROM held GROUP BY date",
    "fixed": "SELECT h.*, CASE WHEN me_lag1 <= coalesce(p20, q20) THEN 20.0 WHEN me_lag1 >= coalesce(p80, q80) THEN 5.0 ELSE 10.0 END AS spread FROM held h JOIN points p ON h.date = p.date",
    "illiquid": "SELECT *, abs(ret) / nullif(abs(prc) * vol, 0) AS illiq FROM held",
    "tamed": "SELECT * EXCLUDE (top), CASE WHEN illiq IS NOT NULL THEN least(illiq, top) END AS w FROM (SELECT *, quantile_cont(illiq, 0.99) OVER (PARTITION BY date) AS top FROM illiquid) t",
    "amihud": "SELECT * EXCLUDE (w), least(greatest(20000 * sqrt(coalesce(w, median(w) OVER (PARTITION BY date), (SELECT median(w) FROM tamed))), 1), 300) AS spread FROM tamed",
    "numbered": "SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY date) AS i FROM held",
    "traded": """SELECT coalesce(a.model, b.model) AS model, coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.signed_w, 0) - coalesce(b.signed_w, 0))) / 2 AS turnover
      FROM numbered a FULL JOIN numbered b ON a.model = b.model AND a.permno = b.permno AND a.i = b.i + 1 GROUP BY ALL""",
    "turnovers": "SELECT n.model, n.date, CASE WHEN n.i = 1 THEN 0 ELSE turnover END AS turnover FROM (SELECT DISTINCT model, date, i FROM numbered) n JOIN traded t ON n.model = t.model AND n.i = t.i",
    "both_spreads": "SELECT 'fixed' AS tc_method, model, date, signed_w, ret_exc, spread FROM fixed UNION ALL SELECT 'amihud', model, date, signed_w, ret_exc, spread FROM amihud",
    "net": """SELECT *, turnover * avg_one_way_spread_bps / 10000 AS tc_cost, gross_ls_ret - turnover * avg_one_way_spread_bps / 10000 AS net_ls_ret
      FROM (SELECT tc_method, b.model, b.date, any_value(turnover) AS turnover, coalesce(sum(signed_w * ret_exc), 0) AS gross_ls_ret, sum(abs(signed_w) * spread) / sum(abs(signed_w)) AS avg_one_way_spread_bps
            FROM both_spreads b JOIN turnovers t ON b.model = t.model AND b.date = t.date GROUP BY tc_method, b.model, b.date) x""",
}


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: spreads, turnover and returns each read it."""
    return cut(costs.holdings(predictions(spark, sf_dir), clean(spark, sf_dir)))


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.monthly_costs(costs.with_spreads(held(spark, sf_dir)), {"fixed": "spread_bps_fixed", "amihud": "spread_bps_amihud"})


@register("signed_weights", O.sql(f"SELECT permno, {O.text_dates('date')}, model, decile, {O.rounded(['signed_w'])} FROM held"))
def signed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(held(spark, sf_dir), ["permno", "date", "model", "decile"], ["signed_w"])


@register("fixed_spread", O.sql(f"SELECT permno, {O.text_dates('date')}, model, spread AS spread_bps_fixed FROM fixed"))
def fixed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(costs.with_spreads(held(spark, sf_dir)), ["permno", "date", "model"], ["spread_bps_fixed"])


@register("amihud_spread", O.sql(f"SELECT permno, {O.text_dates('date')}, model, round(spread, 5) AS spread_bps_amihud FROM amihud"))
def amihud_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(costs.with_spreads(held(spark, sf_dir)), ["permno", "date", "model"], ["spread_bps_amihud"], 5)


@register("ls_turnover", O.sql(f"SELECT model, {O.text_dates('date')}, {O.rounded(['turnover'])} FROM turnovers"))
def ls_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(costs.turnover(held(spark, sf_dir)), ["model", "date"], ["turnover"])


_NET = ["gross_ls_ret", "avg_one_way_spread_bps", "turnover", "tc_cost", "net_ls_ret"]


@register("net_returns", O.sql(f"SELECT tc_method, model, {O.text_dates('date')}, {O.rounded(_NET)} FROM net"))
def net_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(net(spark, sf_dir), ["tc_method", "model", "date"], _NET)


_SUM = ["ann_ret_gross", "ann_vol_gross", "sharpe_gross", "ann_ret_net", "ann_vol_net", "sharpe_net", "sharpe_delta", "mean_turnover", "mean_spread_bps", "mean_tc_cost_monthly"]


@register(
    "tc_rank_change",
    O.sql(
        f"""SELECT tc_method, model, n_months, rank_gross, rank_net, rank_net - rank_gross AS rank_change, {O.rounded(_SUM)} FROM (
        SELECT *, sharpe_net - sharpe_gross AS sharpe_delta, CAST(dense_rank() OVER (PARTITION BY tc_method ORDER BY sharpe_gross DESC NULLS LAST) AS INT) AS rank_gross, CAST(dense_rank() OVER (PARTITION BY tc_method ORDER BY sharpe_net DESC NULLS LAST) AS INT) AS rank_net FROM (
        SELECT tc_method, model, count(DISTINCT date) AS n_months, avg(turnover) AS mean_turnover, avg(avg_one_way_spread_bps) AS mean_spread_bps, avg(tc_cost) AS mean_tc_cost_monthly, {_ANN.format('gross_ls_ret', '_gross')}, {_ANN.format('net_ls_ret', '_net')} FROM net GROUP BY ALL) a) b"""
    ),
)
def tc_rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(costs.cost_summary(cut(net(spark, sf_dir))), ["tc_method", "model", "n_months", "rank_gross", "rank_net", "rank_change"], _SUM)


_TC = [_alpha_ctes(f"tc_{k}", "net", ["tc_method", "model"], f"{k}_ls_ret") for k in ("gross", "net")]
_TC_ALPHA = ["alpha_annual_gross", "t_alpha_gross", "alpha_annual_net", "t_alpha_net"]


@register(
    "tc_summary_alpha",
    O.sql(f"SELECT g.tc_method, g.model, round(g.alpha_annual, 5) + 0.0 AS alpha_annual_gross, round(g.t_alpha, 5) + 0.0 AS t_alpha_gross, round(n.alpha_annual, 5) + 0.0 AS alpha_annual_net, round(n.t_alpha, 5) + 0.0 AS t_alpha_net FROM {_TC[0]} g JOIN {_TC[1]} n ON g.tc_method = n.tc_method AND g.model = n.model"),
)
def tc_summary_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross and net alphas of the cost summary."""
    return show(costs.cost_summary(cut(net(spark, sf_dir)), tables(spark, sf_dir, "raw_factors")["raw_factors"]), ["tc_method", "model"], _TC_ALPHA, 5)


@register("top_rank_changes", O.sql("SELECT tc_method, model, place, round(mean_turnover, 6) AS mean_turnover FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tc_method ORDER BY mean_turnover DESC, model) AS INT) AS place FROM (SELECT tc_method, model, avg(turnover) AS mean_turnover FROM net GROUP BY ALL) a) b WHERE place <= 2"))
def top_rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(diagnostics.top_per_group(costs.cost_summary(net(spark, sf_dir)), ["tc_method"], [F.desc("mean_turnover"), F.col("model")], 2), ["tc_method", "model", "place"], ["mean_turnover"])


# Descriptions.
@register("entities_by_year", O.sql("SELECT year(date) AS year, count(DISTINCT permno) AS n_entities FROM clean GROUP BY 1"))
def entities_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.entities_by_year(clean(spark, sf_dir)).withColumn("year", F.col("year").cast("long"))


@register("hist_returns", O.sql("SELECT CASE WHEN ret < -1 THEN 0 WHEN ret >= 2 THEN 121 ELSE CAST(floor((ret + 1) / (3.0 / 120)) AS BIGINT) + 1 END AS bin, count(*) AS n FROM clean WHERE ret IS NOT NULL GROUP BY 1"))
def hist_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.histogram(clean(spark, sf_dir), "ret", -1.0, 2.0)


_MISS = ["a_ceq", "a_xrd", "a_capx", "q_ibq", "q_xrdq"]


@register("missing_shares", O.sql("SELECT year, feature, round(s, 6) AS missing_share FROM (UNPIVOT (SELECT year(date) AS year, " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in _MISS) + f" FROM merged GROUP BY 1) ON {', '.join(_MISS)} INTO NAME feature VALUE s)"))
def missing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(diagnostics.missing_shares(merged(spark, sf_dir), _MISS).withColumn("year", F.col("year").cast("long")), ["year", "feature"], ["missing_share"])


@register("describe_returns", O.sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS high FROM clean" for c in ("ret", "me"))))
def describe_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(diagnostics.describe(clean(spark, sf_dir), ["ret", "me"]), ["feature", "n"], ["mean", "std", "low", "q25", "median", "q75", "high"])


_IC = ["mom1m", "turn", "bm", "gma", "hire"]
O.CTES |= {
    "long_form": f"SELECT date, ret_exc, feature, value FROM (UNPIVOT (SELECT date, ret_exc, {', '.join(_IC)} FROM targeted) ON {', '.join(_IC)} INTO NAME feature VALUE value)",
    "feature_ranks": f"SELECT feature, date, {_avg_rank('value', 'feature, date')} AS rx, {_avg_rank('ret_exc', 'feature, date')} AS ry FROM long_form WHERE value IS NOT NULL",
    "feature_ics": "SELECT feature, date, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM feature_ranks GROUP BY ALL HAVING count(*) >= 10",
}


@register("feature_ic", O.sql("SELECT feature, n_months, CAST(row_number() OVER (ORDER BY abs(mean_ic) DESC NULLS LAST, feature) AS INT) AS place, round(mean_ic, 6) AS mean_ic, round(std_ic, 6) AS std_ic, round(mean_ic / nullif(std_ic, 0), 6) AS icir FROM (SELECT feature, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, count(ic) AS n_months FROM feature_ics GROUP BY feature) t"))
def feature_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, *MERGED, "raw_factors")
    df = panel.excess_target(panel.raw_features(raw, _IC), raw["raw_factors"])
    return show(diagnostics.feature_ic(df, _IC, "ret_exc"), ["feature", "n_months", "place"], ["mean_ic", "std_ic", "icir"])


_COR = ["turn", "bm", "gma"]


@register("feature_correlations", O.sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM targeted" for i, a in enumerate(_COR) for b in _COR[i:])))
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, *MERGED, "raw_factors")
    return show(diagnostics.correlations(panel.excess_target(panel.raw_features(raw, _COR), raw["raw_factors"]), _COR), ["a", "b"], ["r"])


@register("seeded_sample", O.sql("SELECT permno, CAST(date AS VARCHAR) AS date FROM clean ORDER BY md5(concat(permno, '|', CAST(date AS VARCHAR), '|42')), permno, date LIMIT 500"))
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(diagnostics.seeded_sample(clean(spark, sf_dir).select("permno", "date"), ["permno", "date"], 500), ["permno", "date"])


@register("largest_moves", O.sql("SELECT permno, CAST(date AS VARCHAR) AS date, round(ret, 6) AS ret FROM clean WHERE ret IS NOT NULL ORDER BY abs(ret) DESC, permno, date LIMIT 20"))
def largest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(diagnostics.top_n(clean(spark, sf_dir).dropna(subset=["ret"]), [F.desc(F.abs("ret")), F.col("permno"), F.col("date")], 20), ["permno", "date"], ["ret"])


@register("many_to_one_guard", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def many_to_one_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    out = joins.many_to_one(s.withColumn("k", F.col("s_nationkey").cast("long")), n.select(F.col("n_nationkey").cast("long").alias("k"), "n_name"), ["k"])
    return joins.require_known(out, ["n_name"]).select("s_suppkey", "n_name")


@register("report_lag_months", O.sql("SELECT 'annual' AS kind, min((year(public_date) - year(datadate)) * 12 + month(public_date) - month(datadate)) AS least FROM annual UNION ALL SELECT 'quarterly', min((year(public_date) - year(datadate)) * 12 + month(public_date) - month(datadate)) FROM quarterly"))
def report_lag_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables(spark, sf_dir, "raw_annual", "raw_quarterly")
    gap = F.min(month_number(F.col("public_date")) - month_number(F.col("datadate"))).cast("long").alias("least")
    return cleaning.clean_annual(raw["raw_annual"]).agg(gap).select(F.lit("annual").alias("kind"), "least").unionByName(cleaning.clean_quarterly(raw["raw_quarterly"]).agg(gap).select(F.lit("quarterly").alias("kind"), "least"))


# Fitted models. SQL states the least-squares ones; tests hold the others to direct solutions on the rows.
_PARTS = {c: f for f in C.FAMILIES for c in C.FAMILIES[f] if c in LINEAR_FEATURES}
O.CTES |= {
    "linear_rows": f"SELECT m.permno, m.date, m.ret, {', '.join(f'{_PARTS[c]}.{c}' for c in LINEAR_FEATURES)} FROM merged m " + " ".join(f"LEFT JOIN feat_{f} {f} ON m.permno = {f}.permno AND m.date = {f}.date" for f in dict.fromkeys(_PARTS.values())),
    "ranked": "SELECT permno, date, lead(ret) OVER (PARTITION BY permno ORDER BY date) AS nxt, " + ", ".join(f"coalesce({O.rank_to_unit(c, 'date')}, 0) AS {c}" for c in LINEAR_FEATURES) + " FROM linear_rows",
    "panel": f"SELECT permno, s.date, nxt - rf AS ret_exc, {', '.join(LINEAR_FEATURES)} FROM ranked s JOIN raw_factors f ON f.date = last_day(s.date + INTERVAL 1 MONTH) WHERE nxt IS NOT NULL",
}


def _ols_cte(model: str, features: list[str], test_year: int) -> str:
    """Puts CTEs that take the constant and the features out of the target one by one, by training rows only, and
    names the one with the predictions: target less what is left of it."""
    name = f"{model}_{test_year}"
    O.CTES[f"{name}_0"] = f"SELECT permno, date, ret_exc, ret_exc AS y, 1.0 AS one, year(date) < {test_year} AS train, {', '.join(features)} FROM panel WHERE year(date) <= {test_year}"
    order = ["one", *features]
    for i, f in enumerate(order):
        part = lambda c, f=f: f"{c} - coalesce(sum({c} * {f}) FILTER (train) OVER () / nullif(sum({f} * {f}) FILTER (train) OVER (), 0), 0) * {f} AS {c}"
        O.CTES[f"{name}_{i + 1}"] = f"SELECT permno, date, ret_exc, train, {', '.join(part(c) for c in ['y', *order[i + 1 :]])} FROM {name}_{i}"
    O.CTES[name] = f"SELECT permno, date, '{model}' AS model, ret_exc - y AS pred_ret FROM {name}_{len(order)} WHERE NOT train"
    return name


_OLS = [_ols_cte(m, f, y) for m, f in (("ols3", list(expanding.SMALL)), ("ols_all", LINEAR_FEATURES)) for y in range(TEST_FROM, TEST_TO + 1)]


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.feature_panel(tables(spark, sf_dir), LINEAR_FEATURES)


YEARS = (HOLD_OUT_FROM, TEST_FROM, TEST_TO)


@register("ols_expanding", O.sql(f"SELECT permno, {O.text_dates('date')}, model, round(pred_ret, 6) + 0.0 AS pred_ret FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in _OLS) + ") u"))
def ols_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on three and on all features, fitted anew for each test year on all years before."""
    p = _panel(spark, sf_dir)
    run = expanding.expanding(p, LINEAR_FEATURES, *YEARS, ["ols3", "ols_all"])
    return show(expanding.predictions(p, run), ["permno", "date", "model"], ["pred_ret"])


@register("pretest_mean", O.sql(f"SELECT round(avg(ret_exc), 9) AS bench FROM panel WHERE year(date) < {TEST_FROM}"))
def pretest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(runs.pretest_mean(_panel(spark, sf_dir), TEST_FROM), [], ["bench"], 9)


@register("linear_expanding")
def linear_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six linear models, fitted anew for each test year on all years before."""
    p = _panel(spark, sf_dir)
    return expanding.predictions(p, expanding.expanding(p, LINEAR_FEATURES, *YEARS))


@register("grid_select")
def grid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out R2 of every candidate of every linear model."""
    from quantloom.models import moments

    years = moments.yearly_moments(_panel(spark, sf_dir), LINEAR_FEATURES)
    early, late = expanding.total(years, 0, HOLD_OUT_FROM - 1), expanding.total(years, HOLD_OUT_FROM, TEST_FROM - 1)
    rows = []
    for name in expanding.LINEAR:
        best, scores = expanding.select(name, early, late, len(LINEAR_FEATURES)) if early and late else ({}, [])
        rows += [(name, str(p), float(s), p == best) for p, s in scores]
    return spark.createDataFrame(rows, "model string, params string, r2 double, chosen boolean")


@register("model_summary")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled fit and rank correlation of the linear models."""
    p = _panel(spark, sf_dir)
    run = expanding.expanding(p, LINEAR_FEATURES, *YEARS)
    return metrics.summary(expanding.predictions(p, run), run.bench)


def _whole_panel(spark: SparkSession, sf_dir: str, keep: Chain, before: int | None = None) -> DataFrame:
    """The panel with all features, written step by step."""
    return panel.feature_panel(tables(spark, sf_dir), keep=keep, aside=keep.aside, before=before)


@register("parsimony_delta")
def parsimony_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of each linear model on all 94 features, on the allowed ones of most importance, and the difference."""
    with Chain(spark) as keep:
        p = _whole_panel(spark, sf_dir, keep)
        small, chosen = runs.small_panel(p, HOLD_OUT_FROM, TEST_FROM, features=C.ALL)
        release(spark)
        fits = [expanding.expanding(x, f, *YEARS) for x, f in ((p, C.ALL), (small, chosen))]
        release(spark)
        both = [metrics.pooled_r2(expanding.predictions(p, r), fits[0].bench) for r in fits]
        return cut(runs.compare(*both))


@register("selected_features")
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small feature set, by importance."""
    with Chain(spark) as keep:
        p = _whole_panel(spark, sf_dir, keep, TEST_FROM)
        chosen = runs.small_panel(p, HOLD_OUT_FROM, TEST_FROM, features=C.ALL)[1]
    return spark.createDataFrame(list(enumerate(chosen, 1)), "place int, feature string")


def _grown(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make, grid = runs.GROWN[name]
    p = cut(_panel(spark, sf_dir))  # read by each fit and by the predictions
    best = trees.select(p, LINEAR_FEATURES, make, grid, HOLD_OUT_FROM, TEST_FROM)[0]
    return trees.expanding(p, LINEAR_FEATURES, name, lambda: make(**best), TEST_FROM, TEST_TO)


@register("forest_expanding")
def forest_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests of the chosen depth, fitted anew for each test year."""
    return _grown(spark, sf_dir, "rf")


@register("boosted_expanding")
def boosted_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of the chosen depth and rate, fitted anew for each test year."""
    return _grown(spark, sf_dir, "gbrt")


@register("perm_importance")
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of all 94 features."""
    with Chain(spark) as keep:
        p = _whole_panel(spark, sf_dir, keep, TEST_FROM)
        return runs.importance(p, C.ALL, HOLD_OUT_FROM, TEST_FROM)


@register("nn_expanding")
def nn_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of one to five layers, the mean of three seeds, trained anew for each test year."""
    return nets.predictions(_panel(spark, sf_dir), LINEAR_FEATURES, list(LAYERS), TEST_FROM, TEST_TO)


@register(
    "completed_years",
    O.sql(
        """SELECT y.year FROM (SELECT year(date) AS year, count(*) AS n FROM preds WHERE model = 'mom' GROUP BY 1) y
        JOIN (SELECT model, year(date) AS year, count(*) AS n FROM preds WHERE model IN ('mom', 'size') GROUP BY 1, 2) h ON y.year = h.year AND y.n = h.n GROUP BY y.year HAVING count(DISTINCT model) = 2"""
    ),
)
def completed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return expanding.completed_years(p, p.filter("model = 'mom'").select("permno", "date"), ["mom", "size"]).withColumn("year", F.col("year").cast("long"))


@register("unit_rank_single", O.sql(f"SELECT permno, {O.text_dates('date')}, round({O.rank_to_unit('ret', 'date')}, 6) + 0.0 AS x FROM clean"))
def unit_rank_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean(spark, sf_dir)
    return show(df.select("permno", "date", unit_rank(F.col("ret"), "date").alias("x")), ["permno", "date"], ["x"])
