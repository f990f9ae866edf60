"""SQL that states each query once more, on its own, for an engine that has ASOF joins and QUALIFY."""

from __future__ import annotations

import re

from quantloom.plans.adapter import TABLES


def d(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def z(a: str) -> str:
    return f"coalesce({a}, 0)"


def L(a: str, k: int = 12) -> str:
    return f"lag({a}, {k}) OVER w"


def pct(a: str, b: str) -> str:
    return d(f"({a}) - ({b})", f"abs({b})")


def grow(a: str) -> str:
    return pct(a, L(a))


def grow0(a: str) -> str:
    return pct(z(a), z(L(a)))


def roll(f: str, a: str, rows: int, least: int) -> str:
    w = f"OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({a}) {w} >= {least} THEN {f}({a}) {w} END"


def comp(near: int, far: int) -> str:
    return f"coalesce(product(1 + coalesce(ret, 0)) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN {far} PRECEDING AND {near} PRECEDING), 1) - 1"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


def rank_to_unit(x: str, by: str) -> str:
    """Average rank of the known x within by, on [-1, 1]."""
    n = f"count({x}) OVER (PARTITION BY {by})"
    k = f"PARTITION BY {by}, {x} IS NULL"
    return f"CASE WHEN {x} IS NOT NULL AND {n} > 1 THEN 2.0 * (rank() OVER ({k} ORDER BY {x}) + (count(*) OVER ({k}, {x}) - 1) / 2.0 - 1) / ({n} - 1) - 1 END"


ANNUAL = "sich at ceq dltt dlc sale cogs xsga xrd dp capx che act lct invt rect ppent ppegt txditc pstkrv pstkl pstk dvt dv ivao ib ni pi oancf txp dcvt emp csho datadate public_date".split()
QUARTERLY = "atq ceqq ibq saleq invtq oancfy xrdq txtq epspxq rdq datadate public_date".split()

CTES: dict[str, str] = dict(TABLES)
CTES |= {
    "spans": "SELECT permno, permco, shrcd, exchcd, comnam, namedt, coalesce(nameendt, DATE '2099-12-31') AS nameendt, nullif(upper(trim(ncusip)), '') AS cusip8, nullif(upper(trim(ticker)), '') AS ticker FROM raw_names",
    "universe": """SELECT m.*, shrcd, exchcd FROM raw_monthly m JOIN spans n ON m.permno = n.permno AND m.date BETWEEN namedt AND nameendt
      QUALIFY row_number() OVER (PARTITION BY m.permno, m.date ORDER BY namedt DESC, nameendt DESC) = 1""",
    "chosen": "SELECT * FROM universe WHERE shrcd IN (10, 11) AND exchcd IN (1, 2, 3)",
    "delisted": """SELECT u.* EXCLUDE (ret), CASE WHEN dl IS NULL THEN ret WHEN ret IS NULL THEN dl ELSE (1 + ret) * (1 + dl) - 1 END AS ret
      FROM chosen u LEFT JOIN (SELECT permno, last_day(date) AS month, CASE WHEN dlret IS NULL AND dlstcd BETWEEN 500 AND 584 THEN -0.3 ELSE dlret END AS dl FROM raw_delistings WHERE dlret IS NOT NULL OR dlstcd BETWEEN 500 AND 584) x
      ON u.permno = x.permno AND last_day(u.date) = x.month""",
    "sized": "SELECT *, abs(prc) * shrout / 1000.0 AS me, abs(prc) / nullif(cfacshr, 0) AS prc_adj FROM delisted",
    "clean": "SELECT *, coalesce(lag(me) OVER (PARTITION BY permno ORDER BY date), me) AS me_lag1 FROM sized",
    "securities": "SELECT gvkey, iid, left(upper(trim(cusip)), 8) AS cusip8, nullif(upper(trim(tic)), '') AS ticker, conm, first_date AS sec_start, coalesce(last_date, DATE '2099-12-31') AS sec_end FROM raw_security WHERE length(left(upper(trim(cusip)), 8)) = 8",
    "by_number": """SELECT permno, permco, gvkey, iid, n.cusip8, greatest(namedt, sec_start) AS link_start, least(nameendt, sec_end) AS link_end, 'cusip' AS link_method
      FROM spans n JOIN securities s ON n.cusip8 = s.cusip8 WHERE datediff('day', greatest(namedt, sec_start), least(nameendt, sec_end)) >= 1""",
    "by_name": """SELECT permno, permco, gvkey, iid, s.cusip8, greatest(namedt, sec_start) AS link_start, least(nameendt, sec_end) AS link_end, 'ticker' AS link_method, conm,
        list_distinct(list_filter(regexp_split_to_array(lower(trim(comnam)), '\\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(trim(coalesce(conm, ''))), '\\s+'), lambda x: x <> '')) AS y
      FROM spans n JOIN securities s ON n.ticker = s.ticker WHERE n.cusip8 IS NOT NULL AND datediff('day', greatest(namedt, sec_start), least(nameendt, sec_end)) >= 1 AND permno NOT IN (SELECT permno FROM by_number)""",
    "by_likeness": "SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS name_sim FROM by_name",
    "by_ticker": "SELECT permno, permco, gvkey, iid, cusip8, link_start, link_end, link_method FROM by_likeness WHERE name_sim >= 0.3 OR NOT (SELECT bool_or(trim(coalesce(conm, '')) <> '') FROM by_likeness)",
    "links": """SELECT * FROM (SELECT * FROM by_number UNION ALL SELECT * FROM by_ticker) x
      QUALIFY row_number() OVER (PARTITION BY permno, link_start ORDER BY CASE link_method WHEN 'cusip' THEN 0 WHEN 'ticker' THEN 1 ELSE 2 END, datediff('day', link_start, link_end) DESC, gvkey, iid) = 1""",
    "linked": """SELECT c.* EXCLUDE (date), last_day(c.date) AS date, gvkey, iid, link_method FROM clean c JOIN links l ON c.permno = l.permno AND last_day(c.date) BETWEEN last_day(link_start) AND last_day(link_end)
      QUALIFY row_number() OVER (PARTITION BY c.permno, c.date ORDER BY CASE link_method WHEN 'cusip' THEN 0 WHEN 'ticker' THEN 1 ELSE 2 END, datediff('day', link_start, link_end) DESC, gvkey) = 1""",
    "annual": "SELECT *, last_day(datadate + INTERVAL 6 MONTH) AS public_date FROM raw_annual",
    "quarterly": "SELECT *, last_day(datadate + INTERVAL 3 MONTH) AS public_date FROM raw_quarterly",
    "with_annual": f"SELECT l.*, {', '.join(f'a.{c} AS a_{c}' for c in ANNUAL)} FROM linked l ASOF LEFT JOIN annual a ON l.gvkey = a.gvkey AND l.date >= a.public_date",
    "merged": f"SELECT l.*, {', '.join(f'q.{c} AS q_{c}' for c in QUARTERLY)}, greatest(floor(coalesce(a_sich, -1) / 10.0), 0) AS ind FROM with_annual l ASOF LEFT JOIN quarterly q ON l.gvkey = q.gvkey AND l.date >= q.public_date",
}

be = "CASE WHEN a_ceq IS NOT NULL THEN a_ceq + coalesce(a_txditc, 0) - coalesce(a_pstkrv, a_pstkl, a_pstk, 0) END"
noa = f"({z('a_at')} - {z('a_che')} - {z('a_ivao')})"
noa_before = f"({z(L('a_at'))} - {z(L('a_che'))} - {z(L('a_ivao'))})"
delta = lambda c: f"({z(c)} - {z(L(c))})"
raw_accruals = f"(({delta('a_act')} - {delta('a_che')}) - ({delta('a_lct')} - {delta('a_dlc')} - {delta('a_txp')}) - {z('a_dp')})"
div_now, div_before = "coalesce(a_dvt, a_dv, 0)", f"coalesce({L('a_dvt')}, {L('a_dv')}, 0)"
margin = lambda s, c: d(f"{s} - {z(c)}", s)
curr, curr_before = d("a_act", "a_lct"), d(L("a_act"), L("a_lct"))
roa_f = d(z("a_ib"), L("a_at"))
rises = [flag(f"({'q_epspxq' if k == 0 else L('q_epspxq', 3 * k)}) - ({L('q_epspxq', 3 * k + 12)}) > 0") for k in range(8)]

#: Expressions over merged with the window w of a firm's rows.
FIRM: dict[str, dict[str, str]] = {
    "momentum": {
        "mom1m": L("ret", 1),
        "mom6m": comp(2, 7),
        "mom12m": comp(2, 13),
        "mom36m": comp(13, 37),
        "chmom": f"({comp(2, 7)}) - ({comp(8, 13)})",
        "turn": roll("avg", d("vol", "shrout * 1000"), 3, 2),
        "std_turn": f"round({roll('stddev_samp', d('vol', 'shrout * 1000'), 3, 2)}, 12)",
        "dolvol": roll("avg", "ln(greatest(abs(prc) * vol, 1e-6))", 3, 2),
        "std_dolvol": roll("stddev_samp", "ln(greatest(abs(prc) * vol, 1e-6))", 3, 2),
    },
    "value": {
        "bm": d(be, "me"),
        "cfp": d(f"{z('a_ib')} + {z('a_dp')}", "me"),
        "ep": d("a_ib", "me"),
        "sp": d("a_sale", "me"),
        "dy": d("coalesce(a_dvt, a_dv, 0)", "me"),
        "lev": d(f"{z('a_dltt')} + {z('a_dlc')}", "a_at"),
        "agr": grow("a_at"),
        "sgr": grow("a_sale"),
        "lgr": grow0("a_dltt"),
        "pchsale_pchinvt": f"{grow('a_sale')} - {grow('a_invt')}",
        "pchsale_pchxsga": f"{grow('a_sale')} - {grow0('a_xsga')}",
        "pchsale_pchgm": f"{grow('a_sale')} - {pct('(a_sale - a_cogs)', f'({L('a_sale')} - {L('a_cogs')})')}",
        "cash": d("a_che", "a_at"),
        "salecash": d("a_sale", "a_che"),
        "saleinv": d("a_sale", "a_invt"),
        "salerec": d("a_sale", "a_rect"),
        "pchsale_pchrect": f"{grow('a_sale')} - {grow0('a_rect')}",
        "pchcurrat": pct(curr, curr_before),
        "sin": flag("a_sich BETWEEN 2100 AND 2199 OR a_sich BETWEEN 2080 AND 2085 OR a_sich IN (7993, 7995)"),
    },
    "profitability": {
        "gp": d(f"a_sale - {z('a_cogs')}", "a_at"),
        "gma": d(f"a_sale - {z('a_cogs')}", L("a_at")),
        "roe": d("a_ib", "a_ceq"),
        "niy": d("a_ni", "a_at"),
        "roic": d("a_ib", f"{z('a_ceq')} + {z('a_dltt')} + {z('a_dlc')}"),
        "pm": d("a_ib", "a_sale"),
        "chpm": f"{d('a_ib', 'a_sale')} - {d(L('a_ib'), L('a_sale'))}",
        "chato": f"{d('nullif(a_sale, 0)', 'a_at')} - {d(L('a_sale'), L('a_at'))}",
        "rd_sale": d(z("a_xrd"), "a_sale"),
        "rd_mve": d(z("a_xrd"), "me"),
        "tb": d("a_ib", "a_pi"),
        "quick": d(f"a_act - {z('a_invt')}", "a_lct"),
        "curr": curr,
        "cashpr": d(f"me + {z('a_dltt')} - {z('a_at')}", "a_che"),
        "roaq": d("q_ibq", L("q_atq", 3)),
        "roeq": d("q_ibq", L("q_ceqq", 3)),
        "rdmq": d(z("q_xrdq"), "me"),
        "chinv": d(f"q_invtq - {L('q_invtq', 3)}", "q_atq"),
        "chtx": d(f"{z('q_txtq')} - {z(L('q_txtq', 3))}", "q_atq"),
        "sue": d(f"q_epspxq - {L('q_epspxq')}", roll("stddev_samp", "q_epspxq", 24, 12)),
        "rs": d(pct("q_saleq", L("q_saleq")), roll("stddev_samp", "q_saleq", 24, 12)),
        "roavol": roll("stddev_samp", d("q_ibq", "q_atq"), 24, 12),
        "stdcf": roll("stddev_samp", d("q_oancfy", "q_atq"), 24, 12),
        "depr": d(z("a_dp"), "a_ppent"),
        "pchdepr": pct(d(z("a_dp"), "a_ppent"), d(z(L("a_dp")), L("a_ppent"))),
        "rna": d("a_ib", f"(({noa} + {noa_before}) / 2)"),
        "rsup": d(f"q_saleq - {L('q_saleq')}", "abs(me)"),
        "nincr": " + ".join("(" + " * ".join(f"({x})" for x in rises[: k + 1]) + ")" for k in range(8)),
        "ps": " + ".join(
            f"({flag(c)})"
            for c in (
                f"{roa_f} > 0",
                f"{d(z('a_oancf'), 'a_at')} > 0",
                f"{roa_f} > {d(z(L('a_ib')), L('a_at', 24))}",
                f"{d(z('a_oancf'), 'a_at')} > {roa_f}",
                f"{d(z('a_dltt'), 'a_at')} < {d(z(L('a_dltt')), L('a_at'))}",
                f"{curr} > {curr_before}",
                f"{z('a_csho')} <= {z(L('a_csho'))}",
                f"{margin('nullif(a_sale, 0)', 'a_cogs')} > {margin(f'nullif({L('a_sale')}, 0)', L('a_cogs'))}",
                f"{d('a_sale', 'a_at')} > {d(L('a_sale'), L('a_at'))}",
            )
        ),
        "orgcap": d(" + ".join([z("a_xsga"), *(f"{0.85**k!r} * {z(L('a_xsga', 12 * k))}" for k in range(1, 15))]), "a_at"),
    },
    "investment": {
        "invest": d(f"{delta('a_ppent')} + {delta('a_invt')}", L("a_at")),
        "noa": d(f"{noa} - ({z('a_at')} - {z('a_dlc')} - {z('a_dltt')} - {z('a_ceq')} - {z('a_txditc')} - coalesce(a_pstkrv, a_pstkl, a_pstk, 0))", L("a_at")),
        "chcsho": f"{d('a_csho', L('a_csho'))} - 1",
        "grprofits": d(f"({z('a_sale')} - {z('a_cogs')}) - ({z(L('a_sale'))} - {z(L('a_cogs'))})", L("a_at")),
        "pchcapex": f"{d(z('a_capx'), L('a_capx'))} - 1",
        "cinvest": d(f"{z('a_capx')} - ({z(L('a_capx'))} + {z(L('a_capx', 24))} + {z(L('a_capx', 36))}) / 3", "a_sale"),
        "tang": d(f"{z('a_che')} + 0.715 * {z('a_rect')} + 0.547 * {z('a_invt')} + 0.535 * {z('a_ppent')}", "a_at"),
        "realestate": d(z("a_ppegt"), "a_at"),
        "acc": d(raw_accruals, f"(({z('a_at')} + {z(L('a_at'))}) / 2)"),
        "absacc": f"abs({d(raw_accruals, f'(({z('a_at')} + {z(L('a_at'))}) / 2)')})",
        "pctacc": d(raw_accruals, "abs(a_ib)"),
        "convind": flag("a_dcvt > 0"),
        "secured": d(z("a_dltt"), f"({z('a_dltt')} + {z('a_dlc')})"),
        "securedind": flag("a_dltt > 0"),
        "divi": flag(f"{div_now} > 0 AND {div_before} = 0"),
        "divo": flag(f"{div_now} = 0 AND {div_before} > 0"),
        "hire": d(f"a_emp - {L('a_emp')}", f"((a_emp + {L('a_emp')}) / 2)"),
    },
}
in_group = lambda c: f"CASE WHEN ind > 0 THEN {c} - avg({c}) OVER (PARTITION BY date, ind) ELSE {c} END"
above = lambda c: flag(f"{c} > median({c}) OVER (PARTITION BY date)")
#: Expressions over the firm expressions of all families.
GROUP: dict[str, dict[str, str]] = {
    "momentum": {
        "indmom": "CASE WHEN ind > 0 THEN avg(mom6m) OVER (PARTITION BY date, ind) END",
        "mve_ia": "CASE WHEN ind > 0 THEN ln(greatest(me, 1e-6)) - avg(ln(greatest(me, 1e-6))) OVER (PARTITION BY date, ind) END",
        "herf": "CASE WHEN ind > 0 THEN sum(a_sale * a_sale) OVER (PARTITION BY date, ind) / nullif(pow(sum(a_sale) OVER (PARTITION BY date, ind), 2), 0) END",
    },
    "value": {f"{c}_ia": in_group(c) for c in ("bm", "cfp", "ep")} | {"pchcapx_ia": in_group("h_capx")},
    "profitability": {
        "chatoia": in_group("chato"),
        "ms": " + ".join(
            f"({x})"
            for x in (flag("h_roa > 0"), flag(f"{z('a_oancf')} > {z('a_ib')}"), flag("h_roa > h_roa_before"), flag("h_cash > h_roa"), above("h_capx_at"), above("h_xrd_at"), above("h_xsga_at"), flag("a_csho <= h_csho"))
        ),
    },
    "investment": {},
}
HELP = {
    "h_capx": grow0("a_capx"),
    "h_roa": d("a_ib", "a_at"),
    "h_roa_before": d(L("a_ib"), L("a_at")),
    "h_cash": d(z("a_oancf"), "a_at"),
    "h_csho": L("a_csho"),
    "h_capx_at": d(z("a_capx"), "a_at"),
    "h_xrd_at": d(z("a_xrd"), "a_at"),
    "h_xsga_at": d(z("a_xsga"), "a_at"),
}
for _f, _items in FIRM.items():
    CTES[f"firm_{_f}"] = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in (_items | HELP).items()) + " FROM merged WINDOW w AS (PARTITION BY permno ORDER BY date)"
    CTES[f"feat_{_f}"] = f"SELECT permno, date, {', '.join([*_items, *(f'{e} AS {n}' for n, e in GROUP[_f].items())])} FROM firm_{_f}"


def sql(final: str, **more: str) -> str:
    """final with all the named parts that it needs, directly or through others."""
    parts, order = CTES | more, []

    def need(text: str) -> None:
        for name in parts:
            if name not in order and re.search(rf"\b(FROM|JOIN|UNPIVOT)\s+{name}\b", text):
                need(parts[name])
                order.append(name)

    need(final)
    seen = list(dict.fromkeys(order))
    return (f"WITH {', '.join(f'{n} AS ({parts[n]})' for n in seen)}\n" if seen else "") + final


def text_dates(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
