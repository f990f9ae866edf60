"""Point-in-time joins. Each is an equi-join on a key with a residual range, never a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: End of an interval that is still open.
OPEN_END = "2099-12-31"


def open_end(c: Column) -> Column:
    return F.coalesce(c, F.lit(OPEN_END).cast("date"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given total order; null keys are keys like any other."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("ql_nth", nth).filter("ql_nth = 1").drop("ql_nth")


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, keys: list[str], order: list[Column]) -> DataFrame:
    """Each point with the interval of its key that holds it (both ends included); of several, the first in order."""
    other = intervals.withColumnRenamed(key, "ql_key")
    joined = points.join(other, (points[key] == other["ql_key"]) & points[at].between(other[start], other[end])).drop("ql_key")
    return first_by(joined, keys, order)


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, known: str, newest: list[Column], prefix: str = "") -> DataFrame:
    """left with the latest row of right whose ``known`` date is not after ``at``, within key; NULLs if none.

    Rows of right are turned into intervals [known, next known), so each left row meets one of them and the
    join needs no ordering of left. Equal known dates are settled by newest, in that order."""
    one = first_by(right.filter(F.col(key).isNotNull() & F.col(known).isNotNull()), [key, known], newest)
    until = F.lead(known).over(Window.partitionBy(key).orderBy(known))
    named = one.withColumn("ql_until", open_end(until)).select(
        F.col(key).alias("ql_key"), F.col(known).alias("ql_from"), "ql_until", *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c not in (key, known)], F.col(known).alias(f"{prefix}{known}")
    )
    on = (left[key] == named["ql_key"]) & (left[at] >= named["ql_from"]) & (left[at] < named["ql_until"])
    return left.join(named, on, "left").drop("ql_key", "ql_from", "ql_until")


def event_window(events: DataFrame, daily: DataFrame, key: str, at: str, day: str, value: str, offsets: tuple[int, int] = (-1, 1)) -> DataFrame:
    """Sum of value over the trading days around the first one on or after each event; NULL if none is known.

    The first day is found as an interval, too: a day answers for all events after the day before it."""
    order = Window.partitionBy(key).orderBy(day)
    indexed = daily.select(F.col(key).alias("ql_key"), F.col(day).alias("ql_day"), F.col(value).alias("ql_value"))
    order = Window.partitionBy("ql_key").orderBy("ql_day")
    indexed = indexed.withColumn("ql_index", F.row_number().over(order)).withColumn("ql_before", F.lag("ql_day").over(order))
    hit = events.join(indexed, (events[key] == indexed["ql_key"]) & (events[at] <= indexed["ql_day"]) & (indexed["ql_before"].isNull() | (events[at] > indexed["ql_before"])))
    near = hit.select(key, at, F.explode(F.sequence(F.col("ql_index") + offsets[0], F.col("ql_index") + offsets[1])).alias("ql_at"))
    values = indexed.select(F.col("ql_key").alias(key), F.col("ql_index").alias("ql_at"), "ql_value")
    return near.join(values, [key, "ql_at"], "left").groupBy(key, at).agg(F.sum("ql_value").alias("window_sum"))


def overlap_join(a: DataFrame, b: DataFrame, on: str, a_span: tuple[str, str], b_span: tuple[str, str], least_days: int = 1) -> DataFrame:
    """Pairs with equal ``on`` whose intervals overlap by at least that many days, with link_start and link_end."""
    start, end = F.greatest(F.col(a_span[0]), F.col(b_span[0])), F.least(F.col(a_span[1]), F.col(b_span[1]))
    return a.join(b, on).withColumn("link_start", start).withColumn("link_end", end).filter(F.datediff("link_end", "link_start") >= least_days)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join that fails while it runs if right has a key twice."""
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = right.withColumn("ql_times", times).withColumn("ql_ok", F.when(F.col("ql_times") > 1, F.raise_error(F.lit(f"keys {keys} are not unique on the right"))).otherwise(F.lit(True)))
    return left.join(checked.filter("ql_ok").drop("ql_times", "ql_ok"), keys, how)


def require_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; a NULL in one of the columns fails the query that reads it."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.filter(F.when(missing, F.raise_error(F.lit(f"NULL in one of {columns}"))).otherwise(F.lit(True)))


def full_grid(rows: DataFrame, a: str, others: DataFrame) -> DataFrame:
    """All values of a with all rows of others (a short list), for joining sparse results to."""
    return rows.select(a).distinct().crossJoin(F.broadcast(others))
