"""Scans: Parquet and CSV with NaN as NULL, yearly shards, run manifests, remote tables and factor files."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.exprs import without_nan


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return without_nan(df.select(*columns) if columns else df)


def yearly(spark: SparkSession, root: str, first: int, last: int, columns: list[str] | None = None) -> DataFrame:
    """Rows of a directory with year=... partitions between two years; missing years are skipped, others not read."""
    df = spark.read.parquet(root).filter(F.col("year").between(first, last))
    return without_nan(df.select(*columns) if columns else df)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return without_nan(spark.read.csv(path, schema=schema, header=True))


def manifest_value(spark: SparkSession, path: str, field: str, default: float) -> Column:
    """A number of a JSON manifest as a literal; the default if the file or the field is not there."""
    try:
        df = spark.read.json(path, multiLine=True)
        row = df.select(field).first() if field in df.columns else None
    except Exception as e:  # only a missing file is an answer
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return F.lit(default if row is None or row[0] is None else float(row[0]))


def number(c: Column) -> Column:
    """Text as a number; what is none is NULL."""
    return c.try_cast("double")


def select_list(template: Iterable[str]) -> list[str]:
    """Column names of a template, one for each line, without comments."""
    return [name for line in template if (name := line.split("#")[0].split("--")[0].strip().rstrip(","))]


@dataclass(frozen=True)
class Pull:
    """A remote table: its columns, the rows that are wanted and their order. dated: the column of the start date."""

    table: str
    columns: str
    order: str
    where: tuple[str, ...] = ()
    dated: str = ""

    def predicates(self, start: str | None = None, years: Iterable[int] = ()) -> list[str]:
        """One condition for each task: of the start date, or of each year."""
        fixed = list(self.where)
        if self.dated and years:
            return [" AND ".join([*fixed, f"{self.dated} >= '{y}-01-01'", f"{self.dated} <= '{y}-12-31'"]) for y in years]
        if self.dated and start:
            fixed.append(f"{self.dated} >= '{start}'")
        return [" AND ".join(fixed) or "1 = 1"]


_STANDARD = ("indfmt = 'INDL'", "datafmt = 'STD'", "popsrc = 'D'", "consol = 'C'")
#: The remote tables, with their columns and filters.
PULLS = {
    "monthly": Pull("crsp.msf", "permno, date, ret, retx, prc, shrout, vol, cfacshr", "permno, date", dated="date"),
    "names": Pull("crsp.msenames", "permno, permco, cusip, ncusip, ticker, comnam, shrcd, exchcd, namedt, nameendt", "permno, namedt"),
    "delistings": Pull("crsp.mse", "permno, date, dlstcd, dlret, dlpdt", "permno, date", ("dlstcd IS NOT NULL",)),
    "index": Pull("crsp.dsi", "date, vwretd, ewretd", "date", dated="date"),
    "daily": Pull("crsp.dsf", "permno, date, ret, vol, prc", "permno, date", dated="date"),
    "annual": Pull(
        "comp.funda",
        "gvkey, datadate, fyear, indfmt, datafmt, popsrc, consol, sich, naicsh, at, lt, ceq, seq, csho, prcc_f, ajex, mkvalt, pstkl, pstkrv, pstk, txditc, txdb, itcb, revt, sale, cogs, xsga, xrd, dp, ib, ni, ebit, ebitda, pi, txt, mii, oancf, capx, dv, fincf, ivncf, act, che, rect, invt, ppent, ppegt, intan, ao, ivao, lct, dlc, dltt, dd1, ap, txp, ob, re, prstkc, sstk, dvc, dvp, dvt, dcvt, xacc, recch, invch, emp",
        "gvkey, datadate",
        _STANDARD,
        "datadate",
    ),
    "quarterly": Pull(
        "comp.fundq",
        "gvkey, datadate, fyearq, fqtr, indfmt, datafmt, popsrc, consol, atq, ltq, ceqq, seqq, cshoq, prccq, ajexq, ibq, saleq, niq, dpq, xrdq, oancfy, capsq, actq, cheq, rectq, invtq, ppentq, lctq, dlcq, dlttq, txdbq, txditcq, txtq, epspxq, epspiq, rdq",
        "gvkey, datadate",
        _STANDARD,
        "datadate",
    ),
    "security": Pull("comp.security", "gvkey, iid, cusip, tic, exchg, tpci", "gvkey, iid"),
    "company": Pull("comp.company", "gvkey, conm, sic, naics, gind, gsector, fic, loc, incorp", "gvkey"),
}


def pull(spark: SparkSession, url: str, source: Pull, start: str | None = None, years: Iterable[int] = (), user: str | None = None, password: str | None = None) -> DataFrame:
    """The wanted rows of a remote table, by one task a year where years are given; all filters run on the server.
    The rows of each task come in the table's order."""
    properties = {"user": user or os.environ.get("DB_USER", ""), "password": password or os.environ.get("DB_PASSWORD", "")}
    properties = {k: v for k, v in properties.items() if v}
    df = spark.read.jdbc(url, f"(SELECT {source.columns} FROM {source.table}) t", predicates=source.predicates(start, years), properties=properties)
    return without_nan(df).sortWithinPartitions(*source.order.split(", "))


#: Where the extension's pulls begin.
EXTENSION = {"monthly": "2017-01-01", "names": None, "delistings": None, "index": "2017-01-01", "daily": 2017, "annual": "2017-01-01", "quarterly": "2016-01-01", "security": None, "company": None}


def pull_extension(spark: SparkSession, url: str, last_year: int, **login: str) -> dict[str, DataFrame]:
    """All tables of the extension, the daily one by years up to the last."""
    return {n: pull(spark, url, PULLS[n], years=range(s, last_year + 1), **login) if isinstance(s, int) else pull(spark, url, PULLS[n], s, **login) for n, s in EXTENSION.items()}


def factor_archive(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the one CSV file in a zip archive, on any store that Spark reads; such an archive is small."""
    import io
    import zipfile

    body = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(body))) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(".csv"))
        lines = z.read(name).decode("utf-8", "replace").splitlines()
    return spark.createDataFrame([(x,) for x in lines], "value string")


def latest(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.max(date).alias("latest"))


def factor_rows(lines: DataFrame, names: list[str]) -> DataFrame:
    """Monthly rows of a factor file amid headings and yearly sums: those that begin with a year and month.

    Months become month ends, per cents fractions, and what is no number NULL."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    kept = lines.filter(F.col("value").rlike(r"^\s*\d{6}\s*,")).select(parts.alias("p"))
    values = [(F.try_element_at("p", F.lit(i + 2)).try_cast("double") / 100).alias(n) for i, n in enumerate(names)]
    return kept.select(F.last_day(F.to_date(F.col("p")[0], "yyyyMM")).alias("date"), *values)


def five_factors(three: DataFrame, five: DataFrame) -> DataFrame:
    """The long three-factor history with the other two where they are known."""
    return three.join(five.select("date", "rmw", "cma"), "date", "left")
