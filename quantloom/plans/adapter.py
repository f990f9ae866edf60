"""Panel inputs out of the star-schema tables: suppliers are firms, shipments are trades and filings.

Each text is plain SQL that any engine runs on the tables it names. Sums are taken over whole cents, so they
are exact and ranks do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_POINTS = "CAST(round((l_discount - l_tax) * 100) AS BIGINT)"


def _items(prefix: str) -> str:
    """Sums that the report items are made of."""
    return f"""count(*) AS n, CAST(sum({_CENTS}) AS DOUBLE) / 100 AS total, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN {_CENTS} ELSE 0 END) AS DOUBLE) / 100 AS part_r,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN {_CENTS} ELSE 0 END) AS DOUBLE) / 100 AS part_a,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN {_CENTS} ELSE 0 END) AS DOUBLE) / 100 AS part_o,
       CAST(sum({_CENTS} * CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 10000 AS tax,
       CAST(sum({_CENTS} * CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 10000 AS {prefix}disc"""


TABLES: dict[str, str] = {
    "raw_monthly": f"""
SELECT permno, date, CASE WHEN (permno + month(date)) % 5 = 0 THEN -prc ELSE prc END AS prc, vol, shrout,
       CAST(1 + permno % 2 AS DOUBLE) AS cfacshr,
       CASE WHEN (permno * 7 + month(date)) % 41 = 0 THEN NULL ELSE value / lag(value) OVER (PARTITION BY permno ORDER BY date) - 1 END AS ret
FROM (SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS date, CAST(sum({_CENTS}) AS DOUBLE) / 100 AS value,
             CAST(sum({_CENTS}) AS DOUBLE) / 100 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS prc,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS vol, CAST(count(*) AS DOUBLE) * 100 AS shrout
      FROM lineitem GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE))) q""",
    "raw_names": """
SELECT s_suppkey AS permno, 500 + CAST(floor(s_suppkey / 2) AS BIGINT) AS permco, 10 + s_suppkey % 4 AS shrcd, CAST(1 + s_nationkey % 4 AS INT) AS exchcd,
       concat('c', lpad(CAST(s_suppkey AS VARCHAR(20)), 7, '0'), ' ') AS ncusip, concat('t', CAST(s_suppkey AS VARCHAR(20))) AS ticker,
       s_name AS comnam, CAST('1995-01-01' AS DATE) AS namedt, CAST('1998-06-30' AS DATE) AS nameendt FROM supplier
UNION ALL
SELECT s_suppkey, 500 + CAST(floor(s_suppkey / 2) AS BIGINT), 10 + s_suppkey % 3, CAST(1 + s_nationkey % 4 AS INT), concat('C', lpad(CAST(s_suppkey AS VARCHAR(20)), 7, '0')), concat(' T', CAST(s_suppkey AS VARCHAR(20))),
       s_name, CAST('1998-07-01' AS DATE), CAST(NULL AS DATE) FROM supplier
UNION ALL
SELECT s_suppkey, 500 + CAST(floor(s_suppkey / 2) AS BIGINT), 11, 1, CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)), s_name, CAST('1997-01-01' AS DATE), CAST('1997-12-31' AS DATE) FROM supplier WHERE s_suppkey % 4 = 0""",
    "raw_delistings": """
SELECT s_suppkey AS permno, CAST('2000-03-15' AS DATE) AS date, CAST(400 + 20 * (s_suppkey % 10) AS INT) AS dlstcd,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE -0.125 END AS dlret FROM supplier WHERE s_suppkey % 6 <> 1
UNION ALL
SELECT s_suppkey, CAST('2000-03-20' AS DATE), 450, CAST(NULL AS DOUBLE) FROM supplier WHERE s_suppkey % 3 = 0""",
    "raw_security": """
SELECT lpad(CAST(s_suppkey + 1000 AS VARCHAR(20)), 6, '0') AS gvkey, '01' AS iid,
       CASE WHEN s_suppkey % 35 = 0 THEN NULL WHEN s_suppkey % 55 = 0 THEN 'c12' WHEN s_suppkey % 5 = 0 THEN concat('x', lpad(CAST(s_suppkey AS VARCHAR(20)), 7, '0')) ELSE concat('c', lpad(CAST(s_suppkey AS VARCHAR(20)), 7, '0'), '9') END AS cusip,
       concat('t', CAST(s_suppkey AS VARCHAR(20)), ' ') AS tic,
       CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN concat(s_name, ' holdings') WHEN s_suppkey % 4 = 2 THEN concat('another ', s_name, ' of this place') ELSE CASE WHEN s_suppkey % 3 = 0 THEN ' ' END END AS conm, CAST('1995-06-30' AS DATE) AS first_date, CAST(NULL AS DATE) AS last_date FROM supplier""",
    "raw_annual": f"""
SELECT gvkey, datadate, sich, total AS at, CASE WHEN n % 9 = 0 THEN NULL ELSE part_r END AS ceq, part_a AS dltt, CASE WHEN n % 11 = 0 THEN NULL ELSE tax END AS dlc,
       total - disc AS sale, CASE WHEN n % 13 = 0 THEN NULL ELSE part_o END AS cogs, CASE WHEN n % 5 = 0 THEN NULL ELSE disc END AS xsga, CASE WHEN n % 3 = 0 THEN NULL ELSE tax / 2 END AS xrd,
       tax / 4 AS dp, CASE WHEN n % 7 = 0 THEN NULL ELSE disc / 3 END AS capx, CASE WHEN n % 10 = 0 THEN 0 ELSE part_r / 8 END AS che, part_a / 2 AS act, part_r / 2 AS lct,
       CASE WHEN n % 8 = 0 THEN 0 ELSE qty * 10.0 END AS invt, part_o / 4 AS rect, part_a / 3 AS ppent, part_a / 2 AS ppegt, CASE WHEN n % 6 = 0 THEN NULL ELSE tax / 8 END AS txditc,
       CASE WHEN n % 4 = 0 THEN NULL ELSE n * 1.0 END AS pstkrv, CASE WHEN n % 2 = 0 THEN NULL ELSE n * 2.0 END AS pstkl, n * 3.0 AS pstk, CASE WHEN n % 5 = 1 THEN NULL WHEN n % 5 = 2 THEN 0 ELSE n * 4.0 END AS dvt,
       CASE WHEN n % 3 = 1 THEN 0 ELSE n * 5.0 END AS dv, CASE WHEN n % 4 = 1 THEN NULL ELSE qty * 1.0 END AS ivao, CASE WHEN n % 12 = 0 THEN NULL ELSE part_r - part_a END AS ib, part_r - part_o AS ni,
       CASE WHEN n % 10 = 1 THEN 0 ELSE part_r - part_a + tax END AS pi, CASE WHEN n % 7 = 1 THEN NULL ELSE part_o - part_a END AS oancf, tax / 16 AS txp, CASE WHEN n % 3 = 0 THEN 0 ELSE qty * 1.0 END AS dcvt,
       CASE WHEN n % 8 = 1 THEN NULL ELSE qty / 4.0 END AS emp, CASE WHEN n % 14 = 0 THEN 0 ELSE qty * 2.0 END AS csho
FROM (SELECT lpad(CAST(l_suppkey + 1000 AS VARCHAR(20)), 6, '0') AS gvkey, make_date(CAST(year(l_shipdate) AS INT), 12, 31) AS datadate, max(CASE WHEN s_nationkey = 3 THEN NULL WHEN s_nationkey = 4 THEN 2100 ELSE s_nationkey * 10 + 5 END) AS sich,
             {_items("")} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, year(l_shipdate)) q""",
    "raw_quarterly": f"""
SELECT gvkey, datadate, fqtr, CASE WHEN n % 17 = 0 THEN 0 ELSE total END AS atq, part_r AS ceqq, CASE WHEN n % 11 = 0 THEN NULL ELSE part_r - part_a END AS ibq, total - disc AS saleq, qty * 10.0 AS invtq, CASE WHEN n % 5 = 0 THEN NULL ELSE part_o - part_a END AS oancfy,
       CASE WHEN n % 3 = 0 THEN NULL ELSE tax / 2 END AS xrdq, CASE WHEN n % 7 = 0 THEN NULL ELSE tax / 8 END AS txtq, (part_r - part_a) / n AS epspxq, rdq
FROM (SELECT lpad(CAST(l_suppkey + 1000 AS VARCHAR(20)), 6, '0') AS gvkey, make_date(CAST(year(l_shipdate) AS INT), CAST(3 * quarter(l_shipdate) AS INT), CASE WHEN quarter(l_shipdate) IN (1, 4) THEN 31 ELSE 30 END) AS datadate,
             quarter(l_shipdate) AS fqtr, CASE WHEN (l_suppkey + year(l_shipdate)) % 9 = 0 THEN NULL ELSE make_date(CAST(year(l_shipdate) + CASE WHEN quarter(l_shipdate) = 4 THEN 1 ELSE 0 END AS INT), CAST(CASE WHEN quarter(l_shipdate) = 4 THEN 2 ELSE 3 * quarter(l_shipdate) + 2 END AS INT), 10) END AS rdq,
             {_items("")} FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)) q""",
    "raw_daily": f"""
SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, CAST(sum({_POINTS}) AS DOUBLE) / 100 / count(*) AS ret,
       CASE WHEN (l_suppkey + day(l_shipdate)) % 13 = 0 THEN 0 ELSE CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS vol,
       CAST(sum({_CENTS}) AS DOUBLE) / 100 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS prc
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), day(l_shipdate)""",
    "raw_market": f"""
SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum({_POINTS}) AS DOUBLE) / 100 / count(*) AS vwretd FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""",
    "raw_factors": """
SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS date, ((year(l_shipdate) * 12 + month(l_shipdate)) * 37 % 101 - 50) / 1000.0 AS mkt_rf,
       ((year(l_shipdate) * 12 + month(l_shipdate)) * 53 % 89 - 44) / 1000.0 AS smb, ((year(l_shipdate) * 12 + month(l_shipdate)) * 71 % 97 - 48) / 1000.0 AS hml,
       ((year(l_shipdate) * 12 + month(l_shipdate)) * 29 % 83 - 41) / 1000.0 AS rmw, ((year(l_shipdate) * 12 + month(l_shipdate)) * 43 % 79 - 39) / 1000.0 AS cma,
       ((year(l_shipdate) * 12 + month(l_shipdate)) * 17 % 7) / 1000.0 AS rf FROM lineitem""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named inputs over the Parquet tables of sf_dir."""
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier")}
    out = {}
    for name in names or TABLES:
        text = TABLES[name]
        for t in base:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        used = {t: df for t, df in base.items() if f"{{{t}}}" in text}
        if name == "raw_daily":  # nearly as many rows as the table: shuffled once, by firm, for the sums and all that follows
            used["lineitem"] = used["lineitem"].repartition("l_suppkey")
        df = spark.sql(text, **used)
        # Decimal literals make decimals in one engine and doubles in another.
        out[name] = df.select(*[df[c].cast("double").alias(c) if k.startswith("decimal") else df[c].cast("long").alias(c) if c in ("permno", "permco", "fqtr", "sich", "dlstcd", "shrcd", "exchcd") else df[c] for c, k in df.dtypes])
    return out
