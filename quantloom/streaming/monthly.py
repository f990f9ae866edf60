"""Monthly sums of a daily stream, each emitted once its month can no longer change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_totals(days: DataFrame, entity: str, time: str, value: str, late: str = "10 days") -> DataFrame:
    """entity, month end, sum and count of value for a streaming or batch frame with a timestamp column.

    State is kept for the months within the lateness bound; rows that come later still are left out."""
    month = F.last_day(F.col(time)).cast("timestamp")
    marked = days.select(entity, value, month.alias("month")).withWatermark("month", late)
    return marked.groupBy(entity, "month").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
