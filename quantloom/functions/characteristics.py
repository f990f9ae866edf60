"""Firm characteristics as column expressions over one merged panel.

``history`` holds expressions over a firm's own rows; ``section`` holds those that compare firms of one date
and may use the first kind by name. Annual report items are a_*, quarterly ones q_*. All are lazy, so reading
three characteristics costs three.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import at_least, change, flag, nonzero, ratio, zero
from quantloom.functions.windows import PanelSpec

SPEC = PanelSpec()
FAMILIES: dict[str, list[str]] = {"momentum": [], "value": [], "profitability": [], "investment": [], "friction": []}
HISTORY: dict[str, Callable[[], Column]] = {}
SECTION: dict[str, Callable[[], Column]] = {}
#: Products of the first step that only the second one needs.
HELPERS: dict[str, Callable[[], Column]] = {}


def _c(name: str) -> Column:
    return F.col(name)


def a(name: str) -> Column:
    return F.col(f"a_{name}")


def q(name: str) -> Column:
    return F.col(f"q_{name}")


def lag(c: Column, k: int = 12) -> Column:
    return SPEC.lag(c, k)


def _put(family: str, kind: dict[str, Callable[[], Column]], **items: Callable[[], Column]) -> None:
    kind.update(items)
    FAMILIES[family].extend(items)


def industry() -> Column:
    """Industry group: the code without its last digit, 0 if missing or negative."""
    return F.greatest(F.floor(F.coalesce(a("sich").cast("double"), F.lit(-1.0)) / 10), F.lit(0)).cast("int")


_SIX, _TWELVE = (2, 7), (2, 13)


def _group_valid() -> Column:
    return F.col("_ind") > 0


def _in_group(c: Column) -> Column:
    return SPEC.mean_gap(c, _group_valid(), "_ind")


# Momentum and activity.
def _turnover() -> Column:
    return ratio(_c("vol"), nonzero(_c("shrout") * 1000))


def _dollar_volume() -> Column:
    return F.log(at_least(F.abs(_c("prc")) * _c("vol"), 1e-6))


_put(
    "momentum",
    HISTORY,
    mom1m=lambda: lag(_c("ret"), 1),
    mom6m=lambda: SPEC.compound(_c("ret"), *_SIX),
    mom12m=lambda: SPEC.compound(_c("ret"), *_TWELVE),
    mom36m=lambda: SPEC.compound(_c("ret"), 13, 37),
    chmom=lambda: SPEC.compound(_c("ret"), *_SIX) - SPEC.compound(_c("ret"), 8, 13),
    turn=lambda: SPEC.rolling(F.avg, _turnover(), 3, 2),
    std_turn=lambda: F.round(SPEC.rolling(F.stddev_samp, _turnover(), 3, 2), 12),
    dolvol=lambda: SPEC.rolling(F.avg, _dollar_volume(), 3, 2),
    std_dolvol=lambda: SPEC.rolling(F.stddev_samp, _dollar_volume(), 3, 2),
)


def _herfindahl() -> Column:
    """Sum of squared sales shares in the group; firms without sales still get the group's value."""
    w = SPEC.cross_section("_ind")
    return F.when(_group_valid(), ratio(F.sum(a("sale") * a("sale")).over(w), nonzero(F.sum(a("sale")).over(w) * F.sum(a("sale")).over(w))))


_put(
    "momentum",
    SECTION,
    indmom=lambda: F.when(_group_valid(), F.avg("mom6m").over(SPEC.cross_section("_ind"))),
    mve_ia=lambda: F.when(_group_valid(), F.log(at_least(_c("me"), 1e-6)) - F.avg(F.log(at_least(_c("me"), 1e-6))).over(SPEC.cross_section("_ind"))),
    herf=_herfindahl,
)


# Value.
def me() -> Column:
    return nonzero(_c("me"))


def book_equity() -> Column:
    return F.when(a("ceq").isNotNull(), a("ceq") + zero(a("txditc")) - F.coalesce(a("pstkrv"), a("pstkl"), a("pstk"), F.lit(0.0)))


def _growth(c: Column) -> Column:
    return change(c, lag(c))


def _growth0(c: Column) -> Column:
    return change(zero(c), zero(lag(c)))


def _current() -> Column:
    return ratio(a("act"), nonzero(a("lct")))


_put(
    "value",
    HISTORY,
    bm=lambda: ratio(book_equity(), me()),
    cfp=lambda: ratio(zero(a("ib")) + zero(a("dp")), me()),
    ep=lambda: ratio(a("ib"), me()),
    sp=lambda: ratio(a("sale"), me()),
    dy=lambda: ratio(F.coalesce(a("dvt"), a("dv"), F.lit(0.0)), me()),
    lev=lambda: ratio(zero(a("dltt")) + zero(a("dlc")), nonzero(a("at"))),
    agr=lambda: _growth(a("at")),
    sgr=lambda: _growth(a("sale")),
    lgr=lambda: _growth0(a("dltt")),
    pchsale_pchinvt=lambda: _growth(a("sale")) - _growth(a("invt")),
    pchsale_pchxsga=lambda: _growth(a("sale")) - _growth0(a("xsga")),
    pchsale_pchgm=lambda: _growth(a("sale")) - _growth(a("sale") - a("cogs")),
    cash=lambda: ratio(a("che"), nonzero(a("at"))),
    salecash=lambda: ratio(a("sale"), nonzero(a("che"))),
    saleinv=lambda: ratio(a("sale"), nonzero(a("invt"))),
    salerec=lambda: ratio(a("sale"), nonzero(a("rect"))),
    pchsale_pchrect=lambda: _growth(a("sale")) - _growth0(a("rect")),
    pchcurrat=lambda: change(_current(), ratio(lag(a("act")), nonzero(lag(a("lct"))))),
    sin=lambda: flag(a("sich").between(2100, 2199) | a("sich").between(2080, 2085) | a("sich").isin(7993, 7995)),
)
HELPERS["_pchcapx"] = lambda: _growth0(a("capx"))
_put(
    "value",
    SECTION,
    bm_ia=lambda: _in_group(_c("bm")),
    cfp_ia=lambda: _in_group(_c("cfp")),
    ep_ia=lambda: _in_group(_c("ep")),
    pchcapx_ia=lambda: _in_group(_c("_pchcapx")),
)


# Profitability.
def _std24(c: Column) -> Column:
    return SPEC.rolling(F.stddev_samp, c, 24, 12)


def _run_of_rises() -> Column:
    """Rises over the same quarter a year before, counted from now back until one fails, eight at most."""
    total, run = F.lit(0.0), F.lit(1.0)
    for k in range(8):
        now = q("epspxq") if k == 0 else lag(q("epspxq"), 3 * k)
        run = run * flag(now > lag(q("epspxq"), 3 * k + 12))
        total = total + run
    return total


def _operating_net(shift: int = 0) -> Column:
    x = (lambda c: zero(lag(c, shift))) if shift else zero
    return x(a("at")) - x(a("che")) - x(a("ivao"))


def _organisation() -> Column:
    total = zero(a("xsga"))
    for k in range(1, 15):
        total = total + 0.85**k * zero(lag(a("xsga"), 12 * k))
    return ratio(total, nonzero(a("at")))


def _f_score() -> Column:
    assets, before = nonzero(a("at")), nonzero(lag(a("at")))
    roa, cash = ratio(zero(a("ib")), before), ratio(zero(a("oancf")), assets)
    sale, sale_before = nonzero(a("sale")), nonzero(lag(a("sale")))
    signals = (
        roa > 0,
        cash > 0,
        roa > ratio(zero(lag(a("ib"))), nonzero(lag(a("at"), 24))),
        cash > roa,
        ratio(zero(a("dltt")), assets) < ratio(zero(lag(a("dltt"))), before),
        _current() > ratio(lag(a("act")), nonzero(lag(a("lct")))),
        zero(a("csho")) <= zero(lag(a("csho"))),
        ratio(sale - zero(a("cogs")), sale) > ratio(sale_before - zero(lag(a("cogs"))), sale_before),
        ratio(a("sale"), assets) > ratio(lag(a("sale")), before),
    )
    return sum((flag(s) for s in signals[1:]), flag(signals[0]))


_put(
    "profitability",
    HISTORY,
    gp=lambda: ratio(a("sale") - zero(a("cogs")), nonzero(a("at"))),
    gma=lambda: ratio(a("sale") - zero(a("cogs")), nonzero(lag(a("at")))),
    roe=lambda: ratio(a("ib"), nonzero(a("ceq"))),
    niy=lambda: ratio(a("ni"), nonzero(a("at"))),
    roic=lambda: ratio(a("ib"), nonzero(zero(a("ceq")) + zero(a("dltt")) + zero(a("dlc")))),
    pm=lambda: ratio(a("ib"), nonzero(a("sale"))),
    chpm=lambda: ratio(a("ib"), nonzero(a("sale"))) - ratio(lag(a("ib")), nonzero(lag(a("sale")))),
    chato=lambda: ratio(nonzero(a("sale")), nonzero(a("at"))) - ratio(lag(a("sale")), nonzero(lag(a("at")))),
    rd_sale=lambda: ratio(zero(a("xrd")), nonzero(a("sale"))),
    rd_mve=lambda: ratio(zero(a("xrd")), me()),
    tb=lambda: ratio(a("ib"), nonzero(a("pi"))),
    quick=lambda: ratio(a("act") - zero(a("invt")), nonzero(a("lct"))),
    curr=_current,
    cashpr=lambda: ratio(_c("me") + zero(a("dltt")) - zero(a("at")), nonzero(a("che"))),
    roaq=lambda: ratio(q("ibq"), nonzero(lag(q("atq"), 3))),
    roeq=lambda: ratio(q("ibq"), nonzero(lag(q("ceqq"), 3))),
    rdmq=lambda: ratio(zero(q("xrdq")), me()),
    chinv=lambda: ratio(q("invtq") - lag(q("invtq"), 3), nonzero(q("atq"))),
    chtx=lambda: ratio(zero(q("txtq")) - zero(lag(q("txtq"), 3)), nonzero(q("atq"))),
    sue=lambda: ratio(q("epspxq") - lag(q("epspxq")), nonzero(_std24(q("epspxq")))),
    rs=lambda: ratio(change(q("saleq"), lag(q("saleq"))), nonzero(_std24(q("saleq")))),
    roavol=lambda: _std24(ratio(q("ibq"), nonzero(q("atq")))),
    stdcf=lambda: _std24(ratio(q("oancfy"), nonzero(q("atq")))),
    depr=lambda: ratio(zero(a("dp")), nonzero(a("ppent"))),
    pchdepr=lambda: change(ratio(zero(a("dp")), nonzero(a("ppent"))), ratio(zero(lag(a("dp"))), nonzero(lag(a("ppent"))))),
    rna=lambda: ratio(a("ib"), nonzero((_operating_net() + _operating_net(12)) / 2)),
    rsup=lambda: ratio(q("saleq") - lag(q("saleq")), nonzero(F.abs(_c("me")))),
    nincr=_run_of_rises,
    ps=_f_score,
    orgcap=_organisation,
)
HELPERS["_roa"] = lambda: ratio(a("ib"), nonzero(a("at")))
HELPERS["_roa_before"] = lambda: ratio(lag(a("ib")), nonzero(lag(a("at"))))
HELPERS["_cash_roa"] = lambda: ratio(zero(a("oancf")), nonzero(a("at")))
HELPERS["_csho_before"] = lambda: lag(a("csho"))
for _item in ("capx", "xrd", "xsga"):
    HELPERS[f"_{_item}_share"] = lambda item=_item: ratio(zero(a(item)), nonzero(a("at")))


def _g_score() -> Column:
    above = lambda c: flag(_c(c) > F.median(c).over(SPEC.cross_section()))
    signals = (
        flag(_c("_roa") > 0),
        flag(zero(a("oancf")) > zero(a("ib"))),
        flag(_c("_roa") > _c("_roa_before")),
        flag(_c("_cash_roa") > _c("_roa")),
        above("_capx_share"),
        above("_xrd_share"),
        above("_xsga_share"),
        flag(a("csho") <= _c("_csho_before")),
    )
    return sum(signals[1:], signals[0])


_put("profitability", SECTION, chatoia=lambda: _in_group(_c("chato")), ms=_g_score)
FAMILIES["profitability"].append("ear")


# Investment and accruals.
def _delta(name: str) -> Column:
    return zero(a(name)) - zero(lag(a(name)))


def _accruals() -> Column:
    return (_delta("act") - _delta("che")) - (_delta("lct") - _delta("dlc") - _delta("txp")) - zero(a("dp"))


def _assets_before() -> Column:
    return nonzero(lag(a("at")))


def _accrual_share() -> Column:
    return ratio(_accruals(), nonzero((zero(a("at")) + zero(lag(a("at")))) / 2))


def _dividend() -> Column:
    return F.coalesce(a("dvt"), a("dv"), F.lit(0.0))


def _dividend_before() -> Column:
    return F.coalesce(lag(a("dvt")), lag(a("dv")), F.lit(0.0))


def _operating_gap() -> Column:
    preferred = F.coalesce(a("pstkrv"), a("pstkl"), a("pstk"), F.lit(0.0))
    owed = zero(a("at")) - zero(a("dlc")) - zero(a("dltt")) - zero(a("ceq")) - zero(a("txditc")) - preferred
    return _operating_net() - owed


_put(
    "investment",
    HISTORY,
    invest=lambda: ratio(_delta("ppent") + _delta("invt"), _assets_before()),
    noa=lambda: ratio(_operating_gap(), _assets_before()),
    chcsho=lambda: ratio(a("csho"), nonzero(lag(a("csho")))) - 1,
    grprofits=lambda: ratio((zero(a("sale")) - zero(a("cogs"))) - (zero(lag(a("sale"))) - zero(lag(a("cogs")))), _assets_before()),
    pchcapex=lambda: ratio(zero(a("capx")), nonzero(lag(a("capx")))) - 1,
    cinvest=lambda: ratio(zero(a("capx")) - (zero(lag(a("capx"))) + zero(lag(a("capx"), 24)) + zero(lag(a("capx"), 36))) / 3, nonzero(a("sale"))),
    tang=lambda: ratio(zero(a("che")) + 0.715 * zero(a("rect")) + 0.547 * zero(a("invt")) + 0.535 * zero(a("ppent")), nonzero(a("at"))),
    realestate=lambda: ratio(zero(a("ppegt")), nonzero(a("at"))),
    acc=_accrual_share,
    absacc=lambda: F.abs(_accrual_share()),
    pctacc=lambda: ratio(_accruals(), nonzero(F.abs(a("ib")))),
    convind=lambda: flag(a("dcvt") > 0),
    secured=lambda: ratio(zero(a("dltt")), nonzero(zero(a("dltt")) + zero(a("dlc")))),
    securedind=lambda: flag(a("dltt") > 0),
    divi=lambda: flag((_dividend() > 0) & (_dividend_before() == 0)),
    divo=lambda: flag((_dividend() == 0) & (_dividend_before() > 0)),
    hire=lambda: ratio(a("emp") - lag(a("emp")), nonzero((a("emp") + lag(a("emp"))) / 2)),
)
FAMILIES["friction"].extend(["beta", "betasq", "idiovol", "ill", "retvol", "maxret", "zerotrade", "me", "age"])
#: All characteristics but those of the daily series (the friction family and ear).
MONTHLY = [c for f in ("momentum", "value", "profitability", "investment") for c in FAMILIES[f] if c != "ear"]
ALL = [c for f in FAMILIES.values() for c in f]


def characteristics(panel: DataFrame, names: list[str] | None = None, keep: Sequence[str | Column] = ()) -> DataFrame:
    """permno, date, what is to be kept of the panel and the named monthly characteristics, without a join."""
    names = MONTHLY if names is None else names
    unknown = [n for n in names if n not in HISTORY and n not in SECTION]
    if unknown:
        raise ValueError(f"not monthly characteristics: {unknown}")
    second = [n for n in names if n in SECTION]
    first = [n for n in HISTORY if n in names or second]
    helpers = {n: make for n, make in HELPERS.items() if second}
    step = panel.select("*", industry().alias("_ind"), *[make().alias(n) for n, make in helpers.items()], *[(HISTORY[n]().alias(n)) for n in first if n not in panel.columns])
    # One shuffle of the wide rows, by date, serves the groups of a date, too, and what ranks a date's rows later.
    step = step.repartition("date") if second else step
    return step.select("permno", "date", *keep, *[SECTION[n]().alias(n) if n in SECTION else F.col(n) for n in names])


# The daily series.
LONG, LONG_LEAST, SHORT, SHORT_LEAST = 252, 120, 21, 10


def daily_measures(daily: DataFrame, market: DataFrame) -> DataFrame:
    """Daily rows with rolling measures. Each mean is over its own known values, as are the moments of beta."""
    r, m = F.col("ret"), F.col("vwretd")
    mean = lambda c: SPEC.rolling(F.avg, c, LONG, LONG_LEAST)
    df = daily.join(F.broadcast(market.select("date", "vwretd")), "date", "left")
    df = df.select("*", (r * m).alias("_rm"), (m * m).alias("_mm"), ratio(F.abs(r), nonzero(F.abs("prc") * F.col("vol"))).alias("_ill"), flag(F.col("vol") == 0).alias("_still"))
    df = df.select("*", ratio(mean(F.col("_rm")) - mean(r) * mean(m), nonzero(mean(F.col("_mm")) - mean(m) * mean(m))).alias("beta"))
    df = df.withColumn("_e", r - F.col("beta") * m).withColumn("_ee", F.col("_e") * F.col("_e"))
    spread = mean(F.col("_ee")) - mean(F.col("_e")) * mean(F.col("_e"))
    short = lambda f, c: SPEC.rolling(f, F.col(c), SHORT, SHORT_LEAST)
    return df.select(
        "permno",
        "date",
        "beta",
        (F.col("beta") * F.col("beta")).alias("betasq"),
        F.sqrt(at_least(spread, 0.0)).alias("idiovol"),
        mean(F.col("_ill")).alias("ill"),
        F.round(short(F.stddev_samp, "ret"), 12).alias("retvol"),  # equal spreads tie, whatever the order of addition
        short(F.max, "ret").alias("maxret"),
        short(F.avg, "_still").alias("zerotrade"),
    )


def last_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each entity's last known value of each column within a month, on the month's end."""
    return df.groupBy("permno", F.last_day("date").alias("date")).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])


FROM_DAYS, FROM_PANEL = ["beta", "betasq", "idiovol", "retvol", "maxret", "ill", "zerotrade"], ["me", "age"]


def month_measures(daily: DataFrame, market: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The daily measures of each entity and month with daily rows; ill is cut at the month's 99th percentile.

    keep may write what both the percentile and the measures are read from."""
    monthly = keep(last_known(daily_measures(daily, market), FROM_DAYS))
    top = monthly.groupBy("date").agg(F.percentile("ill", F.lit(0.99)).alias("_top"))
    return monthly.join(F.broadcast(top), "date", "left").withColumn("ill", F.when(F.col("ill").isNotNull(), F.least("ill", "_top"))).drop("_top")


def panel_measures() -> dict[str, Column]:
    """The friction characteristics that are expressions over the panel."""
    first = F.min("date").over(Window.partitionBy("permno"))
    return {"me": F.log(at_least(F.col("me"), 1e-6)), "age": F.datediff("date", first) / 365.25}


def friction(panel: DataFrame, daily: DataFrame, market: DataFrame) -> DataFrame:
    """Friction characteristics of each entity and month with daily rows; me and age come from the panel."""
    slim = panel.select("permno", F.last_day("date").alias("date"), *[c.alias(n) for n, c in panel_measures().items()])
    return month_measures(daily, market).join(slim, ["permno", "date"], "left").select("permno", "date", *FAMILIES["friction"])
