"""Null-safe scalar expressions. Missing is NULL throughout: scans turn NaN into NULL, ratios over zero are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero(c: Column) -> Column:
    """Missing as 0."""
    return F.coalesce(c, F.lit(0.0))


def nonzero(c: Column) -> Column:
    """Zero as missing."""
    return F.nullif(c, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(now: Column, before: Column) -> Column:
    """Relative change over the size of the earlier value."""
    return ratio(now - before, nonzero(F.abs(before)))


def at_least(c: Column, low: float) -> Column:
    """Lower clip that keeps NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def at_most(c: Column, high: Column) -> Column:
    """Upper clip that gives NULL if either side is."""
    return F.when(c.isNotNull() & high.isNotNull(), F.least(c, high))


def flag(c: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def month_end(c: Column) -> Column:
    return F.last_day(c)


def month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def public_date(c: Column, lag_months: int) -> Column:
    """Month end from which a report of that date may be used."""
    return F.last_day(F.add_months(c, lag_months))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL in every floating column; aggregates then skip it."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two names' lower-case words; NULL if either is NULL."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")) for c in (a, b))
    return ratio(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))
