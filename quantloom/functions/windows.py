"""Window expressions over a panel: an entity's rows by time, or the cross-section of one date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "permno"
    time: str = "date"

    @property
    def history(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.time)

    def cross_section(self, *more: str | Column) -> WindowSpec:
        return Window.partitionBy(self.time, *more)

    def lag(self, c: Column, k: int) -> Column:
        """The value k rows back; gaps in time are not bridged."""
        return F.lag(c, k).over(self.history)

    def lead(self, c: Column, k: int = 1) -> Column:
        return F.lead(c, k).over(self.history)

    def rolling(self, function, c: Column, rows: int, least: int) -> Column:  # noqa: ANN001
        """function over the last rows rows if at least least of them have a value."""
        w = self.history.rowsBetween(1 - rows, 0)
        return F.when(F.count(c).over(w) >= least, function(c).over(w))

    def compound(self, c: Column, nearest: int, farthest: int) -> Column:
        """Compound return of the rows from farthest to nearest back; missing rows and values count as 0."""
        w = self.history.rowsBetween(-farthest, -nearest)
        return F.coalesce(F.product(F.lit(1.0) + F.coalesce(c, F.lit(0.0))).over(w), F.lit(1.0)) - 1.0

    def mean_gap(self, c: Column, valid: Column, *group: str | Column) -> Column:
        """c less its mean in the date's group where the group is valid, else c."""
        return F.when(valid, c - F.avg(c).over(self.cross_section(*group))).otherwise(c)


def average_rank(c: Column, *by: str | Column) -> Column:
    """Rank among the non-missing values of the partition, ties at their mean rank."""
    known = Window.partitionBy(*by, c.isNull())
    return F.when(c.isNotNull(), F.rank().over(known.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c.isNull(), c)) - 1) / 2)


def unit_rank(c: Column, *by: str | Column) -> Column:
    """Average rank scaled to [-1, 1]; NULL where only one value is known."""
    n = F.count(c).over(Window.partitionBy(*by))
    return F.when(n > 1, F.lit(2.0) * (average_rank(c, *by) - 1) / (n - 1) - 1)


def quantile_bucket(order: WindowSpec, whole: WindowSpec, buckets: int = 10) -> Column:
    """Bucket of each row by equal-frequency cuts of its rank: cut points are interpolated between ranks, so
    bucket b ends at rank 1 + (n - 1) b / buckets, inclusive. Not ntile, whose remainders go to the first."""
    r, n = F.row_number().over(order), F.count(F.lit(1)).over(whole)
    return F.when(n == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor((F.lit(buckets) * (r - 1) + n - 2) / (n - 1)).cast("int")))
