import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quantloom.functions import exprs
from quantloom.functions.windows import PanelSpec, average_rank, quantile_bucket, unit_rank
from quantloom.models import expanding, moments, nets, trees
from quantloom.operators import cleaning, costs, diagnostics, joins, linking, metrics, panel, portfolio, subperiods
from quantloom.plans import queries, runs
from quantloom.plans.adapter import tables
from quantloom.sources import readers, sinks
from pyspark.sql import Window

D = dt.date


def month(i):
    return D(2000 + i // 12, i % 12 + 1, 28)


def series(spark, values, name="ret"):
    return spark.createDataFrame([(1, month(i), v) for i, v in enumerate(values)], f"permno long, date date, {name} double")


def column(df, c, order="date"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


@pytest.mark.parametrize(
    "values, wanted",
    [([10e3, 20e3, 30e3, 40e3, 50e3], [-1, -0.5, 0, 0.5, 1]), ([1.0, None, 3.0], [-1, None, 1]), ([1.0, 1.0, 2.0], [-0.5, -0.5, 1]), ([5.0], [None])],
)
def test_unit_rank(spark, values, wanted):
    df = spark.createDataFrame([(i, D(2000, 1, 31), v) for i, v in enumerate(values)], "permno long, date date, x double")
    assert column(df.select("permno", unit_rank(F.col("x"), "date").alias("r")), "r", "permno") == wanted
    wide = panel.rank_columns(df, ["x"], ["permno", "date"])
    assert column(wide, "x", "permno") == wanted


def test_average_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None])], "i int, x double").withColumn("g", F.lit(1))
    assert column(df.select("i", average_rank(F.col("x"), "g").alias("r")), "r", "i") == [2.5, 1.0, 2.5, None]


@pytest.mark.parametrize("rets, wanted", [([0.05] * 14, 1.05**12 - 1), ([0.0] * 14, 0.0), ([-1.0] + [0.1] * 13, -1.0), ([None] * 14, 0.0)])
def test_compound(spark, rets, wanted):
    got = column(series(spark, rets).select("date", PanelSpec().compound(F.col("ret"), 2, 13).alias("m")), "m")
    assert got[0] == 0 and abs(got[-1] - wanted) < 1e-12


def test_rolling_counts_known_values(spark):
    got = column(series(spark, [1.0, None, 3.0, 5.0]).select("date", PanelSpec().rolling(F.avg, F.col("ret"), 3, 2).alias("m")), "m")
    assert got == [None, None, 2.0, 4.0]


def test_ratios(spark):
    df = spark.createDataFrame([(0, 20.0, 100.0), (1, -10.0, 100.0), (2, 5.0, 0.0), (3, 0.0, 0.0), (4, None, 1.0)], "i int, a double, b double")
    assert column(df.select("i", exprs.ratio(F.col("a"), F.col("b")).alias("r")), "r", "i") == [0.2, -0.1, None, None, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "i int, x double")
    assert exprs.without_nan(df).agg(F.avg("x")).first()[0] == 3.0


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 37, 100])
def test_quantile_bucket_is_by_interpolated_cuts(spark, n):
    w = Window.partitionBy("g")
    df = spark.range(n).withColumn("g", F.lit(1)).withColumn("b", quantile_bucket(w.orderBy("id"), w))
    cuts = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, 11)[1:-1])
    wanted = [1 if n == 1 else int(np.searchsorted(np.round(cuts, 9), r)) + 1 for r in range(1, n + 1)]
    assert column(df, "b", "id") == wanted


def test_interval_join_takes_the_latest(spark):
    points = spark.createDataFrame([(1, D(2000, 5, 1)), (1, D(1990, 1, 1)), (2, D(2000, 5, 1)), (None, D(2000, 5, 1))], "permno long, date date")
    spans = spark.createDataFrame([(1, D(1999, 1, 1), D(2000, 5, 1), "a"), (1, D(2000, 1, 1), D(2001, 1, 1), "b"), (None, D(1999, 1, 1), D(2001, 1, 1), "c")], "permno long, a date, b date, x string")
    got = joins.interval_join(points, spans, "permno", "date", "a", "b", ["permno", "date"], [F.desc("a")]).collect()
    assert [(r["permno"], r["x"]) for r in got] == [(1, "b")]


def test_asof_join(spark):
    left = spark.createDataFrame([("g", month(i)) for i in range(6)] + [("h", month(0)), (None, month(0))], "k string, date date")
    right = spark.createDataFrame([("g", month(1), 1, D(1999, 1, 1)), ("g", month(1), 2, D(1999, 6, 1)), ("g", month(4), 3, D(1999, 9, 1)), (None, month(0), 9, D(1999, 1, 1))], "k string, known date, v int, at date")
    got = {(r["k"], r["date"]): r["x_v"] for r in joins.asof_join(left, right, "k", "date", "known", [F.desc("at")], "x_").collect()}
    assert [got["g", month(i)] for i in range(6)] == [None, 2, 2, 2, 3, 3] and got["h", month(0)] is None and got[None, month(0)] is None


def test_event_window(spark):
    daily = spark.createDataFrame([(1, D(2000, 1, d), float(d)) for d in (3, 4, 5, 10)], "permno long, date date, ret double")
    events = spark.createDataFrame([(1, D(2000, 1, 1)), (1, D(2000, 1, 4)), (1, D(2000, 1, 6)), (1, D(2000, 1, 11))], "permno long, rdq date")
    got = {r["rdq"].day: r["window_sum"] for r in joins.event_window(events, daily, "permno", "rdq", "date", "ret").collect()}
    assert got == {1: 7.0, 4: 12.0, 6: 15.0}


def test_guards(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="NULL in one of"):
        joins.require_known(spark.createDataFrame([(None,)], "k int"), ["k"]).collect()


def test_delistings(spark):
    m = spark.createDataFrame([(1, D(2000, 1, 31), 0.1), (2, D(2000, 1, 31), None), (3, D(2000, 1, 31), 0.1)], "permno long, date date, ret double")
    d = spark.createDataFrame([(1, D(2000, 1, 10), 500, None), (2, D(2000, 1, 10), 200, -0.5), (3, D(2000, 1, 10), 300, None), (1, D(2000, 1, 20), 300, None), (2, D(2000, 1, 20), None, None)], "permno long, date date, dlstcd int, dlret double")
    assert [round(x, 9) for x in column(cleaning.adjust_delistings(m, d), "ret", "permno")] == [round(1.1 * 0.7 - 1, 9), -0.5, 0.1]


def test_public_dates(spark):
    df = spark.createDataFrame([("a", D(2005, 12, 31), 1), ("a", D(2005, 12, 31), 2)], "gvkey string, datadate date, x int")
    got = cleaning.clean_annual(df).collect()
    assert [(r["x"], r["public_date"]) for r in got] == [(2, D(2006, 6, 30))]
    assert cleaning.clean_quarterly(df).first()["public_date"] == D(2006, 3, 31)


def test_links_are_sound(spark, sf):
    t = tables(spark, sf, "raw_names", "raw_security")
    links = linking.build_links(t["raw_names"], t["raw_security"])
    assert links.filter("link_start > link_end or gvkey is null or permno is null").count() == 0
    assert links.groupBy("permno", "link_start").count().filter("count > 1").count() == 0
    assert links.filter("permco is null").count() == 0 and {r[0] for r in links.select("link_method").distinct().collect()} == {"cusip", "ticker"}


def test_links_ask_for_numbers_and_names(spark):
    """Securities without a whole number and names without any are gone before the ticker is tried; once any security
    of the pairs has a name, blank ones fail."""
    names = [(p, 10 * p, f" {c} " if c else c, f"t{p}", "Alpha Beta", D(1990, 1, 1), None) for p, c in ((1, "aaaaaaaa"), (2, "bbbbbbbb"), (3, None), (4, "dddddddd"), (5, "  "), (6, "ffffffff"))]
    names = spark.createDataFrame(names, "permno long, permco long, ncusip string, ticker string, comnam string, namedt date, nameendt date")

    def linked(conms):
        rows = [(f"g{p}", "01", c, f"T{p}", conms.get(p)) for p, c in ((1, "AAAAAAAA9"), (2, "ZZZZZZZZ9"), (3, "CCCCCCCC9"), (4, None), (5, "EEEEEEEE9"), (6, "YYYYYYYY9"))]
        sec = spark.createDataFrame(rows, "gvkey string, iid string, cusip string, tic string, conm string")
        return {(r["permno"], r["permco"], r["link_method"]) for r in linking.build_links(names, sec).collect()}

    assert linked({}) == {(1, 10, "cusip"), (2, 20, "ticker"), (6, 60, "ticker")}
    assert linked({2: "beta gamma"}) == {(1, 10, "cusip"), (2, 20, "ticker")}
    assert linked({6: "one two three"}) == {(1, 10, "cusip")}


def test_ranks_do_not_know_who_stays(spark):
    """Three firms, of which one has no next month, keep the ranks of three; targets of the others follow."""
    df = spark.createDataFrame([(p, D(2000, m, 30 + m % 2), 0.1 * p, float(p)) for m in (1, 3) for p in (1, 2, 3) if not (p == 3 and m == 3)], "permno long, date date, ret double, x double").withColumn("date", F.last_day("date"))
    f = spark.createDataFrame([(D(2000, m, 28), 0.0) for m in range(1, 6)], "date date, rf double")
    ranked = panel.rank_columns(df, ["x"], ["permno", "date", "ret"])
    got = {(r["permno"], r["date"].month): r["x"] for r in panel.excess_target(ranked, f).collect()}
    assert got == {(1, 1): -1.0, (2, 1): 0.0}


def test_feature_panel_ranks_the_whole_month(spark, sf):
    t = tables(spark, sf)
    ranked = panel.rank_columns(panel.raw_features(t, ["mom12m"]), ["mom12m"], ["permno", "date"]).fillna(0.0, subset=["mom12m"])
    p = panel.feature_panel(t, ["mom12m"])
    assert p.join(ranked, ["permno", "date"]).filter(p["mom12m"] != ranked["mom12m"]).count() == 0 and p.count() > 0
    assert p.count() < ranked.count()


def test_no_lookahead(spark, sf):
    m = queries.merged(spark, sf)
    assert m.filter("a_public_date > date or q_public_date > date").count() == 0
    assert m.filter("month(a_datadate) = 12 and year(a_datadate) = year(date)").count() == 0
    assert m.filter("date <> last_day(date)").count() == 0
    assert m.count() == m.select("permno", "date").distinct().count()


def test_ranges_of_scores(spark, sf):
    from quantloom.functions.characteristics import ALL, MONTHLY, characteristics

    assert len(ALL) == len(set(ALL)) == 94
    f = characteristics(queries.merged(spark, sf), ["sin", "nincr", "ps", "ms", "herf"])
    bad = "sin not in (0, 1) or not nincr between 0 and 8 or not ps between 0 and 9 or not ms between 0 and 8 or not herf between 0 and 1 + 1e-9"
    assert f.filter(bad).count() == 0 and f.count() > 0
    with pytest.raises(ValueError):
        characteristics(queries.merged(spark, sf), ["beta"])
    assert len(MONTHLY) == 84


def test_feature_panel(spark, sf):
    p = panel.feature_panel(tables(spark, sf), ["mom1m", "bm", "beta", "ear"]).toPandas()
    x = p[["mom1m", "bm", "beta", "ear"]]
    assert len(p) and x.notna().all().all() and x.abs().max().max() <= 1 and p.ret_exc.notna().all()


def test_hac_is_the_double_sum():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(80), rng.standard_normal((80, 2))])
    y = x @ [0.1, 0.5, -0.2] + np.convolve(rng.standard_normal(84), np.ones(5), "valid")
    beta, se = portfolio.hac_regression(y, x, 4)
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    s = sum(max(0, 1 - abs(i - j) / 5) * e[i] * e[j] * np.outer(x[i], x[j]) for i in range(80) for j in range(80))
    inv = np.linalg.inv(x.T @ x)
    assert np.allclose(se, np.sqrt(np.diag(inv @ s @ inv))) and np.allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0])


def test_alpha_falls_back_and_rejects(spark):
    rows = [(month(i), 0.01 * i % 0.07, 0.001 * i, 0.002 * (i % 5), None, None) for i in range(30)]
    f = spark.createDataFrame([(d.replace(day=1), *r) for d, *r in rows], "date date, mkt_rf double, smb double, hml double, rmw double, cma double")
    ls = spark.createDataFrame([("m", month(i), 0.02 + 0.01 * math.sin(i)) for i in range(30)], "model string, date date, ls_ret double")
    assert portfolio.factor_alpha(ls, f, ["model"]).first()["n_obs"] == 30
    assert portfolio.factor_alpha(ls, f, ["model"], align="realised").first()["n_obs"] == 29
    with pytest.raises(ValueError):
        portfolio.factor_alpha(ls, f, ["model"], model="ff9")


def test_month_ends_meet_trading_days(spark):
    preds = spark.createDataFrame([(p, D(1987, 5, 31), "m", float(p), 0.01) for p in range(20)], "permno long, date date, model string, pred_ret double, ret_exc double")
    sizes = spark.createDataFrame([(p, D(1987, 5, 29), 1.0 + p) for p in range(20)], "permno long, date date, me_lag1 double")
    assert portfolio.build_portfolios(preds, sizes).select("decile").distinct().count() == 10


def test_holdings_are_cut_among_known_rows(spark):
    rows = [(p, D(2000, 1, 31), "m", float(p), 0.01) for p in range(1, 25)]
    preds = spark.createDataFrame(rows, "permno long, date date, model string, pred_ret double, ret_exc double")
    details = [(p, D(2000, 1, 28), 1.0 + p, 1, None if p == 24 else 0.1, None if p == 23 else 5.0, None if p == 22 else 9.0) for p in range(1, 25)]
    details[0] = (1, D(2000, 1, 28), -1.0, 1, 0.1, 5.0, 9.0)
    d = spark.createDataFrame(details, "permno long, date date, me_lag1 double, exchcd int, ret double, prc double, vol double")
    held = costs.with_spreads(costs.holdings(preds, d)).toPandas().sort_values("permno")
    assert list(held.permno) == [2, 3, 20, 21] and list(held.decile) == [1, 1, 10, 10] and abs(held.signed_w.sum()) < 1e-12 and abs(held.abs_w.sum() - 1) < 1e-12
    illiq = 0.1 / (5.0 * 9.0)
    assert np.allclose(held.spread_bps_amihud, 20000 * math.sqrt(illiq) if 20000 * math.sqrt(illiq) < 300 else 300)
    with pytest.raises(Exception, match="NULL in one of"):
        costs.holdings(preds.withColumn("ret_exc", F.when(F.col("permno") > 3, 0.01)), d).collect()


def test_spreads_of_a_date_with_two_values(spark):
    rows = [("m", D(2000, 1, 31), p, 10.0 * p, 2, r, 1.0, v, 1, 0.0, 0.25, 0.25) for p, r, v in ((1, 1e-6, 1.0), (2, 3e-6, 1.0), (3, 1e-6, 0.0), (4, None, 1.0))]
    h = spark.createDataFrame(rows, "model string, date date, permno long, me_lag1 double, exchcd int, ret double, prc double, vol double, decile int, ret_exc double, signed_w double, abs_w double")
    got = costs.with_spreads(h).toPandas().set_index("permno").spread_bps_amihud
    top = 1e-6 + 0.99 * 2e-6
    assert np.allclose(got.loc[[1, 2, 3, 4]], [20000 * math.sqrt(x) for x in (1e-6, top, (1e-6 + top) / 2, (1e-6 + top) / 2)])


@pytest.mark.parametrize("few", [100_000, 5_000])
def test_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(diagnostics, "FEW", few)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.round(rng.standard_normal(12_000), 1), rng.lognormal(0, 8, 8001)])
    df = spark.createDataFrame([(float(a), None if i % 2 else float(i)) for i, a in enumerate(x)] + [(None, None)], "a double, b double").repartition(5)
    got = {r["feature"]: r["q"] for r in diagnostics.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9999, 1.0]).collect()}
    assert np.allclose(got["a"], np.quantile(x, [0.0, 0.25, 0.5, 0.9999, 1.0])) and np.allclose(got["b"], np.quantile(np.arange(0.0, 20_001, 2), [0.0, 0.25, 0.5, 0.9999, 1.0]))
    none = diagnostics.describe(df.limit(0), ["a"]).first()
    assert none["n"] == 0 and none["median"] is None


def test_turnover_first_month_and_exits(spark):
    h = spark.createDataFrame([("m", month(0), 1, 0.5), ("m", month(0), 2, -0.5), ("m", month(3), 2, 0.5), ("m", month(3), 3, -0.5)], "model string, date date, permno long, signed_w double")
    assert column(costs.turnover(h), "turnover") == [0.0, 1.0]


def test_rank_correlation(spark):
    rows = [("a", float(i), float(i * i)) for i in range(6)] + [("b", 1.0, float(i)) for i in range(6)] + [("c", 1.0, 2.0)] * 3
    got = {r["g"]: r["ic"] for r in metrics.rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got == {"a": 1.0, "b": None}


def test_incomplete_rows_give_no_r2(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2), ("a", None, 0.1), ("b", 0.1, 0.1), ("b", 0.2, 0.3)], "model string, pred_ret double, ret_exc double")
    got = {r["model"]: r["oos_r2"] for r in metrics.pooled_r2(df, 0.0).collect()}
    assert got["a"] is None and abs(got["b"] - 0.9) < 1e-12


def test_periods(spark):
    p = spark.createDataFrame([("m", month(i), 1, 0.1 * i, 0.1) for i in range(6)], "model string, date date, permno long, pred_ret double, ret_exc double")
    t = subperiods.period_table(spark, [("all", "2000-01-01", "2000-12-31"), ("none", "2010-01-01", "2010-12-31")])
    got = {r["period"]: r["n_months"] for r in subperiods.period_r2(p, t, 0.0).collect()}
    assert got == {"all": 6, "none": None}
    assert subperiods.is_complete(p, "2000-01-31", "2000-06-30") and not subperiods.is_complete(p, "2000-01-31", "2000-07-31")
    assert subperiods.constant_months(p).count() == 0


def test_period_metrics_leave_out_what_does_not_vary(spark):
    rng = np.random.default_rng(4)
    rows = [(p, D(2000 + m // 12, m % 12 + 1, 28), k, 0.5 if k == "nn4" or (k == "rf" and m == 5) else float(rng.standard_normal()), 0.02 * p + 0.01 * float(rng.standard_normal())) for k in ("rf", "nn4", "ols3") for m in range(30) for p in range(20) if not (k == "ols3" and m == 7)]
    preds = spark.createDataFrame(rows, "permno long, date date, model string, pred_ret double, ret_exc double").withColumn("date", F.last_day("date"))
    sizes = spark.createDataFrame([(p, D(2000 + m // 12, m % 12 + 1, 27), 1.0 + p) for m in range(30) for p in range(20)], "permno long, date date, me_lag1 double")
    factors = spark.createDataFrame([(D(2000 + m // 12, m % 12 + 1, 28), *map(float, rng.standard_normal(5))) for m in range(30)], "date date, mkt_rf double, smb double, hml double, rmw double, cma double")
    t = subperiods.period_table(spark, [("all", "2000-01-01", "2002-12-31"), ("first", "2000-01-01", "2000-12-31"), ("none", "2010-01-01", "2010-12-31")])
    got = subperiods.period_metrics(preds, sizes, factors, t, 0.0)
    months = {(r["model"], r["period"]): r["n_months"] for r in got["oos_r2"].collect()}
    assert months == {("rf", "all"): 29, ("rf", "first"): 11, ("rf", "none"): None, ("ols3", "all"): 29, ("ols3", "first"): 11, ("ols3", "none"): None}
    assert {(r["model"], r["period"]): r["n_months"] for r in got["ic_stats"].collect()} == {k: v for k, v in months.items() if v}
    perf = got["portfolio_perf"].toPandas().set_index(["model", "period"])
    assert len(perf) == 4 and perf.loc[("rf", "all"), "n_obs"] == 29 and perf.t_alpha.notna().all()
    best = {r["period"]: r["model"] for r in subperiods.best_by_period(got["portfolio_perf"], "sharpe").collect()}
    assert best == {p: max(("rf", "ols3"), key=lambda m: perf.loc[(m, p), "sharpe"]) for p in ("all", "first")}
    assert subperiods.missing_months(preds, "2000-01-31", "2002-06-30").collect()[0]["model"] == "ols3"
    order = spark.createDataFrame([("nn5",), ("ols3",), ("other",)], "m string").select("m", subperiods.report_place(F.col("m")).alias("o"))
    assert {r["m"]: r["o"] for r in order.collect()} == {"nn5": 13, "ols3": 1, "other": 14}


def _moments(x, y):
    z = np.column_stack([np.ones(len(y)), x, y])
    return moments.Moments(z.T @ z)


def test_linear_models_from_sums():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5)) + 1
    y = x @ [1, 0, -2, 0.5, 0] + rng.standard_normal(300)
    m, xc, yc = _moments(x, y), x - x.mean(0), y - y.mean()
    assert np.allclose(moments.ols(m)[1], np.linalg.lstsq(xc, yc, rcond=None)[0])
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    assert np.allclose(moments.pcr(m, 2)[1], vt[:2].T @ ((u[:, :2].T @ yc) / s[:2]))
    e, f, b = xc.copy(), yc.copy(), []
    for _ in range(3):  # on the rows
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        b.append((w, e.T @ t / (t @ t), f @ t / (t @ t)))
        e, f = e - np.outer(t, b[-1][1]), f - t * b[-1][2]
    w, p, q = (np.array(z) for z in zip(*b, strict=True))
    assert np.allclose(moments.pls(m, 3)[1], w.T @ np.linalg.inv(p @ w.T) @ q)
    fit = moments.elastic_net(m, 0.1, 0.5)
    gradient = xc.T @ (xc @ fit[1] - yc) / 300 + 0.05 * fit[1]
    on = fit[1] != 0
    assert np.allclose(gradient[on], -0.05 * np.sign(fit[1][on]), atol=1e-6) and (np.abs(gradient[~on]) <= 0.05 + 1e-6).all()
    assert np.allclose(m.squared_error(*fit), ((y - fit[0] - x @ fit[1]) ** 2).sum())


def test_expanding_windows_see_only_the_past(spark):
    rng = np.random.default_rng(0)
    rows = [(p, D(y, 6, 30), *map(float, rng.standard_normal(3)), float(rng.standard_normal())) for y in range(2000, 2006) for p in range(30)]
    df = spark.createDataFrame(rows, "permno long, date date, me double, bm double, z double, ret_exc double")
    run = expanding.expanding(df, ["me", "bm", "z"], 2002, 2004, 2005)
    assert {m for m, _ in run.fits} == set(expanding.LINEAR) and {r["n_train"] for r in run.manifest if r["year"] == 2005} == {150}
    pdf = df.toPandas()
    train = pdf[[d.year < 2005 for d in pdf.date]]
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train[["me", "bm", "z"]]]), train.ret_exc, rcond=None)[0]
    got = expanding.predictions(df, run).filter("model = 'ols_all' and year(date) = 2005").toPandas().sort_values("permno")
    want = pdf[[d.year == 2005 for d in pdf.date]].sort_values("permno")
    assert np.allclose(got.pred_ret, np.column_stack([np.ones(len(want)), want[["me", "bm", "z"]]]) @ beta)
    assert run.fits["ols3", 2005][1][2] == 0
    with pytest.raises(ValueError):
        expanding.expanding(df, ["me"], 2002, 2004, 2005, ["nope"])


def test_small_set():
    ranked = [f"x{i}" for i in range(10)] + list(trees.ALLOWED)
    assert trees.small_set(ranked) == list(trees.ALLOWED)[:15]
    assert trees.small_set(["bm"]) == ["bm"] and len(trees.small_set(list(trees.ALLOWED) + ["x"] * 4)) == 15
    with pytest.raises(ValueError, match="none of"):
        trees.small_set(["x"])


def test_model_queries_ask_for_the_whole_job(spark, monkeypatch):
    """What the queries hand to the operators, which fit nothing here."""
    rows = [(1, D(y, 6, 30), 0.1, *[0.5] * len(queries.LINEAR_FEATURES)) for y in range(1996, 2002)]
    df = spark.createDataFrame(rows, "permno long, date date, ret_exc double, " + ", ".join(f"{f} double" for f in queries.LINEAR_FEATURES))
    asked = []
    monkeypatch.setattr(queries, "_panel", lambda *a: df)
    monkeypatch.setattr(queries, "_whole_panel", lambda *a: df)
    monkeypatch.setattr(trees, "select", lambda p, f, make, grid, *years: (asked.append(("select", f, grid, years)), (grid[-1], []))[1])
    monkeypatch.setattr(trees, "expanding", lambda p, f, name, make, a, b: (asked.append((name, f, make(), a, b)), df)[1])
    for name in ("forest_expanding", "boosted_expanding"):
        queries.QUERIES[name](spark, "")
    features = queries.LINEAR_FEATURES
    assert asked[0] == ("select", features, [{"depth": 2}, {"depth": 3}, {"depth": 4}], (1998, 2000))
    assert asked[2] == ("select", features, [{"depth": 1, "rate": 0.01}, {"depth": 2, "rate": 0.01}], (1998, 2000))
    rf, gbrt = asked[1], asked[3]
    assert (rf[1], rf[2].getNumTrees(), rf[2].getMaxDepth(), rf[2].getMinInstancesPerNode(), *rf[3:]) == (features, 300, 4, 1000, 2000, 2001)
    assert (gbrt[1], gbrt[2].getMaxIter(), gbrt[2].getMaxDepth(), gbrt[2].getMinInstancesPerNode(), *gbrt[3:]) == (features, 300, 2, 1000, 2000, 2001)

    asked.clear()
    monkeypatch.setattr(nets, "predictions", lambda p, f, layers, *years, **k: (asked.append((f, layers, years, k)), df)[1])
    queries.QUERIES["nn_expanding"](spark, "")
    assert asked == [(features, [1, 2, 3, 4, 5], (2000, 2001), {})]

    asked.clear()
    monkeypatch.setattr(queries.runs, "importance", lambda p, f, *years: (asked.append((f, years)), df)[1])
    queries.QUERIES["perm_importance"](spark, "")
    assert asked == [(queries.C.ALL, (1998, 2000))]


def test_panel_is_shuffled_as_it_is_and_written_in_steps(spark, sf):
    import os

    from quantloom.operators.checkpoints import Chain

    rows = [(p, D(2000, m, 28), None if p == 3 else x, y) for m in (1, 2) for p, x, y in ((1, 2.0, 1.0), (2, -0.0, None), (3, 9.0, None), (4, 0.0, None), (5, float("nan"), None))]
    df = spark.createDataFrame(rows, "permno long, date date, x double, y double")
    ranked = panel.rank_columns(df, ["x", "y"], ["permno", "date"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r["permno"], r["date"].month): (r["x"], r["y"]) for r in ranked.collect()}
    want = df.select("permno", "date", *[unit_rank(F.col(c), "date").alias(c) for c in "xy"]).collect()
    assert got == {(r["permno"], r["date"].month): (r["x"], r["y"]) for r in want} and len(got) == 10 and got[2, 1][0] == got[4, 1][0]
    seen = []
    with Chain(spark) as keep:
        p = panel.feature_panel(tables(spark, sf), ["me", "bm", "beta"], lambda x: (seen.append(keep(x)), seen[-1])[1])
        left = [f for f in os.listdir(keep.path.removeprefix("file:").rpartition("/")[0]) if f.startswith("chain-")]
        assert len(seen) == 3 and left == [keep.path.rpartition("/")[2]]
        key = lambda r: (r["permno"], r["date"])
        assert sorted(p.collect(), key=key) == sorted(panel.feature_panel(tables(spark, sf), ["me", "bm", "beta"]).collect(), key=key)
        assert len(p._jdf.queryExecution().analyzed().toString()) < 1000
        old = keep.path.removeprefix("file:")
    assert not os.path.exists(old)


def test_steps_leave_no_shuffle_files_and_wide_rows_move_once(spark, sf):
    import os
    import re

    from quantloom.functions.characteristics import characteristics
    from quantloom.operators.checkpoints import CLEANUP, Chain

    t, names = tables(spark, sf), ["mom1m", "bm_ia", "herf"]
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    there = lambda: {f"{d}/{f}" for x in folders for d, _, files in os.walk(x) for f in files if f.startswith("shuffle")}
    before, conf = there(), spark.conf.get(CLEANUP, None)
    with Chain(spark) as keep:
        one, two = keep.aside(t["raw_monthly"].groupBy("permno").agg(F.max("ret").alias("x"))), keep.aside(t["raw_market"])
        assert not there() - before and spark.conf.get(CLEANUP, None) == conf
        old = [p.removeprefix("file:") for p in keep.beside]
        assert keep.path is None and len(old) == 2 and all(map(os.path.exists, old)) and two.count() > 0
        merged = keep(panel.merged_panel(t))
        assert not any(map(os.path.exists, old)) and keep.beside == []
        ranked = panel.rank_columns(characteristics(merged, names), names, ["permno", "date"])
        exchanges = re.findall(r"Exchange hashpartitioning\((.*)", ranked._jdf.queryExecution().executedPlan().toString())
        assert [e.split("#")[0] for e in exchanges] == ["date", "permno"]
        whole = panel.feature_panel(t, names)
        early = panel.feature_panel(t, names, keep, keep.aside, 1998)
        assert sorted(early.collect()) == sorted(whole.filter("year(date) < 1998").collect()) and 0 < early.count() < whole.count()


def test_parsimony_outlives_the_written_panel(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(p, D(y, 6, 30), *map(float, rng.standard_normal(4))) for y in range(1996, 2002) for p in range(20)]
    df = spark.createDataFrame(rows, "permno long, date date, me double, bm double, mom12m double, ret_exc double")
    kept = []
    monkeypatch.setattr(queries.C, "ALL", ["me", "bm", "mom12m"])
    monkeypatch.setattr(queries, "_whole_panel", lambda s, d, keep: (kept.append(keep), keep(df))[1])
    monkeypatch.setattr(queries.runs, "small_panel", lambda p, *a, **k: (p.select("permno", "date", "ret_exc", "me"), ["me"]))
    out = queries.QUERIES["parsimony_delta"](spark, "")
    assert kept[0].path is None and {r["model"] for r in out.collect()} == set(expanding.LINEAR)
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 1000


def test_steps_are_small_plans_and_give_memory_back(spark, sf, monkeypatch):
    from quantloom.operators import checkpoints

    steps, released, t = [], [], tables(spark, sf)
    release = checkpoints.release
    monkeypatch.setattr(checkpoints, "release", lambda s: (released.append(len(steps)), release(s)))
    with checkpoints.Chain(spark) as keep:
        write = keep._write
        monkeypatch.setattr(keep, "_write", lambda df: (steps.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")), write(df))[1])
        got = keep(panel.merged_panel(t, keep.aside)).collect()
        assert released == list(range(1, len(steps) + 1)) and max(steps) <= 12
    assert released[-1] == len(steps) and len(released) == len(steps) + 1
    whole = panel.merged_panel(t)
    key = lambda r: (r["permno"], r["date"])
    assert sorted(got, key=key) == sorted(whole.collect(), key=key) and len(got) > 0


def test_boosted_trees_are_one_task_and_as_mllibs(spark):
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] > 0.2) * (1 + 0.5 * (x[:, 1] > 0)) + 0.1 * rng.standard_normal(3000)
    rows = trees.vectors(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, ret_exc double"), ["a", "b", "c"]).cache()
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    for depth in (1, 2):
        spark.sparkContext.setJobGroup("boosted", "")
        before = jobs()
        model = trees.boosted(depth, 0.1, 20, 100).fit(rows)
        assert jobs() - before <= 3
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        want = GBTRegressor(featuresCol="ql_x", labelCol="ret_exc", predictionCol="pred_ret", maxIter=20, stepSize=0.1, maxDepth=depth, subsamplingRate=0.5, minInstancesPerNode=100, seed=42).fit(rows)
        a, b = (np.array([r[0] for r in m.transform(rows).select("pred_ret").collect()]) for m in (model, want))
        assert np.corrcoef(a, b)[0, 1] > 0.999 and ((a - y) ** 2).mean() < 1.02 * ((b - y) ** 2).mean()
    assert trees.boosted(2, 0.1, 5, 100).fit(rows.repartition(7)).trees == model.trees[:5]
    assert trees.boosted(2, 0.1, 3, 2000).fit(rows).transform(rows).select("pred_ret").distinct().count() == 1
    assert [r[0] for r in trees.boosted().fit(rows.limit(0)).transform(rows.limit(2)).select("pred_ret").collect()] == [0.0, 0.0]


def test_permutation_importance(spark):
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(0)
    rows = [(p, D(2000, 1, 31), *map(float, x), float(2 * x[0] + 0.5 * x[1])) for p, x in enumerate(rng.standard_normal((400, 3)))]
    df = spark.createDataFrame(rows, "permno long, date date, a double, b double, c double, ret_exc double")
    model = LinearRegression(featuresCol="ql_x", labelCol="ret_exc", predictionCol="pred_ret").fit(trees.vectors(df, ["a", "b", "c"]))
    got = {r["feature"]: r for r in trees.permutation_importance(model, df.repartition(3), ["a", "b", "c"], 0.0).collect()}
    assert [got[f]["place"] for f in "abc"] == [1, 2, 3] and got["a"]["importance"] > 1.5 and abs(got["c"]["importance"]) < 1e-3
    assert [r["feature"] for r in trees.permutation_importance(model, df, ["a", "b", "c"], 0.0, ["b"]).collect()] == ["b"]


def _importance_row_by_row(spark, model, rows, features, bench, seed=42):
    """From the model's own predictions of all rows, each feature moved on in the hashed order."""
    at = rows.orderBy(F.xxhash64("permno", "date", F.lit(seed)), "permno", "date").select("ret_exc", *features).toPandas()
    r2 = lambda t: trees.r2(model.transform(trees.vectors(spark.createDataFrame(pa.Table.from_pandas(t)), features)), bench)
    steps = np.random.default_rng(seed).integers(1, max(len(at), 2), len(features))
    return {f: r2(at) - r2(at.assign(**{f: np.roll(at[f], k)})) for f, k in zip(features, steps, strict=True)}


def _random_months(spark, firms, first, months):
    x = [(F.xxhash64("id", F.lit(k)) / F.lit(2.0**63)).alias(c) for k, c in enumerate("abce")]
    date = F.last_day(F.add_months(F.lit(first).cast("date"), (F.col("id") / firms).cast("int"))).alias("date")
    return spark.range(0, firms * months, 1, 4).select((F.col("id") % firms).alias("permno"), date, *x).select("permno", "date", "a", "b", "c", (F.col("a") + 0.5 * F.col("b") + F.col("e")).alias("ret_exc"))


def test_importance_counts_every_row_of_the_hold_out_years(spark, monkeypatch):
    features, forest = ["a", "b", "c"], trees.forest
    df = _random_months(spark, 5000, "1997-07-01", 30).withColumn("a", F.when(F.col("permno") > 9, F.col("a")))
    hold = df.filter("year(date) >= 1998")
    assert hold.count() == 120_000
    model = forest(2, 5).fit(trees.vectors(df.filter("year(date) < 1998"), features))
    monkeypatch.setattr(trees, "forest", lambda depth: forest(depth, 5))
    got = {r["feature"]: r["importance"] for r in runs.importance(df, features, 1998, 2000).collect()}
    want = _importance_row_by_row(spark, model, hold.fillna(0.0), features, hold.agg(F.avg("ret_exc")).first()[0])
    assert got == pytest.approx(want, abs=1e-10) and got["a"] > got["b"] > 0


def _scored(spark, monkeypatch, query):
    """Rows that the query scores, of 110,000 in the hold-out years, and its result."""
    features, forest, measure, scored = ["bm", "me", "mom1m"], trees.forest, trees.permutation_importance, []
    df = _random_months(spark, 5000, "1997-09-01", 26).withColumnsRenamed(dict(zip("abc", features, strict=True)))
    monkeypatch.setattr(queries.C, "ALL", features)
    monkeypatch.setattr(queries, "_whole_panel", lambda *a: df)
    monkeypatch.setattr(trees, "forest", lambda depth: forest(depth, 3))
    monkeypatch.setattr(trees, "permutation_importance", lambda model, rows, *a: (scored.append(rows.count()), measure(model, rows, *a))[1])
    out = queries.QUERIES[query](spark, "").collect()
    return scored, out


def test_perm_importance_scores_every_row(spark, monkeypatch):
    scored, out = _scored(spark, monkeypatch, "perm_importance")
    assert scored == [110_000] and {r["feature"] for r in out} == {"bm", "me", "mom1m"}


def test_selected_features_scores_every_row(spark, monkeypatch):
    scored, out = _scored(spark, monkeypatch, "selected_features")
    assert scored == [110_000] and [r["place"] for r in out] == [1, 2, 3] and out[0]["feature"] == "bm"


def test_importance_does_not_depend_on_blocks(spark, monkeypatch):
    from pyspark.ml.regression import LinearRegression

    features, df = ["a", "b", "c"], _random_months(spark, 100, "1998-01-01", 5)
    fitted = [m.fit(trees.vectors(df, features)) for m in (trees.forest(3, 20, 10), LinearRegression(featuresCol="ql_x", labelCol="ret_exc", predictionCol="pred_ret"))]
    for model in fitted:
        want = _importance_row_by_row(spark, model, df, features, 0.1)
        for block in (7, 100, 1000):
            monkeypatch.setattr(trees, "BLOCK", block)
            got = {r["feature"]: r["importance"] for r in trees.permutation_importance(model, df.repartition(3), features, 0.1).collect()}
            assert got == pytest.approx(want, abs=1e-10)
    unread = trees.forest(2, 3, 1000).fit(trees.vectors(df, features))
    assert [(r["feature"], r["importance"], r["place"]) for r in trees.permutation_importance(unread, df, features, 0.1).collect()] == [("a", 0.0, 1), ("b", 0.0, 2), ("c", 0.0, 3)]
    assert [r["importance"] for r in trees.permutation_importance(unread, df.limit(0), features, 0.1).collect()] == [None] * 3
    with pytest.raises(TypeError, match="BoostedModel"):
        trees.permutation_importance(trees.BoostedModel([], []), df, features, 0.1)


def test_train_appends_and_resumes(spark, tmp_path, monkeypatch):
    from quantloom.plans import runs

    rng = np.random.default_rng(0)
    features = ["me", "bm", "mom12m"]
    rows = [(p, D(y, 6, 30), *map(float, rng.standard_normal(4))) for y in range(2000, 2006) for p in range(30)]
    df = spark.createDataFrame(rows, "permno long, date date, me double, bm double, mom12m double, ret_exc double")
    path = str(tmp_path / "preds")
    of = lambda: {(r["model"], r["year"]): r["count"] for r in spark.read.parquet(path).groupBy("model", "year").count().collect()}
    with pytest.raises(ValueError, match="unknown models"):
        runs.train(df, path, ["nope"], 2002, 2004, 2005)
    assert runs.train(df, path, ["ols3"], 2002, 2004, 2005) == [2004, 2005]
    assert runs.train(df, path, ["ols_all"], 2002, 2004, 2004, append=True) == [2004]
    assert of() == {("ols3", 2004): 30, ("ols3", 2005): 30, ("ols_all", 2004): 30}
    assert runs.train(df, path, ["ols_all"], 2002, 2004, 2005, append=True, resume=True) == [2005]
    assert runs.train(df, path, ["ols3", "ols_all"], 2002, 2004, 2005, append=True, resume=True) == []
    assert runs.train(df, path, ["nn2", "ols3"], 2002, 2004, 2004, features=features) == [2004] and of() == {("nn2", 2004): 30, ("ols3", 2004): 30}
    names = {r["model"] for r in spark.read.json(f"{path}_manifest/*/*").collect()}
    assert {"ols3", "ols_all", "nn2"} <= names


def test_command_line(spark, sf, tmp_path, monkeypatch):
    from quantloom import __main__ as cli

    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    for n, df in tables(spark, sf).items():
        df.write.parquet(f"{raw}/{n}")
    whole = panel.feature_panel
    monkeypatch.setattr(cli.panel, "feature_panel", lambda r: whole(r, ["me", "bm", "mom12m"]))
    years = ["--hold-out-from", "1998", "--test-from", "2000", "--test-to", "2001"]
    run = lambda stage, *more: cli.main([stage, "--raw", raw, "--out", out, *years, *more], spark)
    run("panel")
    run("train", "--models", "ols3", "pcr")
    assert {r["model"] for r in run("evaluate")["eval_oos_r2"].collect()} == {"ols3", "pcr"}
    assert run("periods", "--period", "all", "2000-01-01", "2001-12-31")["periods_oos_r2"].count() == 2
    assert run("costs")["tc_summary"].count() == 4
    assert spark.read.csv(f"{out}/eval/eval_portfolio_perf", header=True).count() == 2
    monkeypatch.setattr(trees, "TREES", 2)
    monkeypatch.setattr(trees, "forest", lambda depth, make=trees.forest: make(depth, trees=3, least_leaf=5))
    delta = run("parsimony", "--models", "ols3")["parsimony_delta"].collect()
    assert {r["model"] for r in delta} == {"ols3", "pcr"}
    assert set(spark.read.json(f"{out}/selected_features").first()["selected_features"]) == {"me", "bm", "mom12m"}


def test_remote_pulls(spark):
    derby = "jdbc:derby:memory:pulls;create=true"
    days = spark.createDataFrame([(1, D(y, m, 3), float(m)) for y in (1999, 2000, 2001) for m in (1, 7)], "permno int, date date, ret double")
    days.toDF("PERMNO", "DT", "RET").write.jdbc(derby, "DAYS", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    src = readers.Pull("DAYS", "permno, dt, ret", "permno, dt", ("ret IS NOT NULL",), "dt")
    assert readers.pull(spark, derby, src, "2000-01-01").count() == 4
    by_year = readers.pull(spark, derby, src, years=range(1999, 2001))
    assert by_year.count() == 4 and by_year.rdd.getNumPartitions() == 2
    assert readers.PULLS["delistings"].predicates() == ["dlstcd IS NOT NULL"] and readers.PULLS["names"].predicates("1957-01-01") == ["1 = 1"]
    assert readers.PULLS["daily"].predicates(years=[2017]) == ["date >= '2017-01-01' AND date <= '2017-12-31'"]
    assert readers.PULLS["annual"].predicates("2017-01-01") == ["indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C' AND datadate >= '2017-01-01'"]
    assert readers.EXTENSION.keys() == readers.PULLS.keys()


def test_factor_archive(spark, tmp_path):
    import zipfile

    for name, text in (("three", "head\n192607, 1.0, 2.0, 3.0, 0.5\n192608, 1, 2, 3, 4\n"), ("five", "192608, 9, 8, 7, 6.0, 5.0, 1\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.CSV", text)
    three = readers.factor_rows(readers.factor_archive(spark, str(tmp_path / "three.zip")), ["mkt_rf", "smb", "hml", "rf"])
    five = readers.factor_rows(readers.factor_archive(spark, str(tmp_path / "five.zip")), ["mkt_rf", "smb", "hml", "rmw", "cma", "rf"])
    got = readers.five_factors(three, five).orderBy("date").collect()
    assert [(r["mkt_rf"], r["rmw"], r["cma"]) for r in got] == [(pytest.approx(0.01), None, None), (pytest.approx(0.01), pytest.approx(0.06), pytest.approx(0.05))]


def test_net_learns():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 3))
    y = np.maximum(x[:, 0], 0) - x[:, 1]
    net = nets.Net(layers=2, units=16, dropout=0.0, rate=1e-2, batch=200, epochs=40).fit(x, y)
    assert ((net.predict(x) - y) ** 2).mean() < 0.2 * y.var()


def test_net_works_in_single_precision():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((300, 4)).astype(np.float32), rng.standard_normal(300).astype(np.float32)
    net = nets.Net(layers=3, units=5, dropout=0.0, l1=0.0)
    net._start(4)
    g = net._gradients(x, y, rng)

    def loss():
        h = x.astype(float)
        for k in range(3):
            z = h @ net.p[f"w{k}"]
            h = np.maximum((z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + 1e-3) * net.p[f"g{k}"] + net.p[f"b{k}"], 0)
        return ((h @ net.p["wo"] + net.p["bo"][0] - y) ** 2).mean()

    for name in ("w0", "w1", "w2", "g0", "g2", "b0", "b1", "wo", "bo"):
        p, at = net.p[name], (0,) * net.p[name].ndim
        assert p.dtype == np.float32 and g[name].dtype == np.float32 and net.norms[0][0].dtype == np.float32
        net.p[name] = p.astype(float)
        sides = []
        for step in (1e-4, -1e-4):
            net.p[name][at] = p[at] + step
            sides.append(loss())
        net.p[name] = p
        assert abs((sides[0] - sides[1]) / 2e-4 - g[name][at]) < 1e-3 + 0.02 * abs(g[name][at]), name
    trained = nets.Net(layers=2, epochs=2, batch=100).fit(x.astype(float), y.astype(float))
    assert {a.dtype for a in trained.p.values()} == {np.dtype(np.float32)} and trained.predict(x).dtype == float


def test_factor_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text("heading\n,Mkt-RF,SMB\n192607,  2.96, -2.56\n192608, x, 1.00\n 1926, 3, 4\nCopyright\n")
    got = readers.factor_rows(spark.read.text(str(tmp_path / "f.csv")), ["mkt_rf", "smb"]).orderBy("date").collect()
    assert [(r["date"], r["mkt_rf"], r["smb"]) for r in got] == [(D(1926, 7, 31), pytest.approx(0.0296), pytest.approx(-0.0256)), (D(1926, 8, 31), None, 0.01)]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("a", D(2000, 1, 31), 1, 0.5), ("b", D(2001, 1, 31), 1, 0.5)], "model string, date date, permno long, pred_ret double")
    path = str(tmp_path / "preds")
    sinks.checkpoint_predictions(p, path)
    sinks.checkpoint_predictions(p.filter("model = 'a'").withColumn("pred_ret", F.lit(0.9)), path)
    assert sorted((r["model"], r["pred_ret"]) for r in spark.read.parquet(path).collect()) == [("a", 0.9), ("b", 0.5)]
    assert readers.yearly(spark, path, 2001, 2001).count() == 1
    sinks.if_absent(p.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    assert readers.parquet(spark, sinks.copy_version(p, str(tmp_path / "v"), "20240101", "preds")).count() == 2
    sinks.csv(p, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "model string, date date, permno long, pred_ret double").count() == 2
    assert r"a\_b" in sinks.latex(spark.createDataFrame([("a_b", 0.5)], "m string, x double"))
    assert spark.range(1).select(readers.manifest_value(spark, str(tmp_path / "none.json"), "x", 0.25)).first()[0] == 0.25
    assert readers.select_list(["a, # one", "", "-- no", "b"]) == ["a", "b"]


def test_result_does_not_depend_on_partitioning(spark, sf):
    t = tables(spark, sf, *queries.MERGED)
    a, b = (panel.merged_panel({k: v.repartition(n) for k, v in t.items()}).select(F.sum(F.xxhash64("permno", "date", "a_at", "q_atq", "me") % 1000003)).first()[0] for n in (1, 7))
    assert a == b


def test_seeded_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a, b = (sorted(r["k"] for r in diagnostics.seeded_sample(d, ["k"], 10).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 10


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_totals_equal_the_batch(spark, sf, tmp_path):
    from quantloom.streaming.monthly import monthly_totals

    days = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity")
    days.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monthly_totals(stream, "l_suppkey", "l_shipdate", "l_quantity", "4000 days").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["l_suppkey"], r["month"], r["total"], r["n"]) for r in df.collect())
    assert key(spark.table("totals")) == key(monthly_totals(days, "l_suppkey", "l_shipdate", "l_quantity"))
