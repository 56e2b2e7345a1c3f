"""Time ranges that filters push into the sources of recordings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual


class TimeRange:
    """The range of a column that pushed filters leave, both ends included; None for no end."""

    def __init__(self, column: str):
        self.column, self.low, self.high = column, None, None

    def push(self, filters: Iterable[Filter]) -> Iterable[Filter]:
        """Takes what filters say about the column.  All are given back, so Spark applies them to the rows that are left."""
        for f in filters:
            if getattr(f, "attribute", None) != (self.column,):
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and (self.low is None or f.value > self.low):
                self.low = f.value
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and (self.high is None or f.value < self.high):
                self.high = f.value
        return list(filters)

    def before(self, value) -> bool:
        return value is not None and self.low is not None and value < self.low

    def after(self, value) -> bool:
        return value is not None and self.high is not None and value > self.high

    def inside(self, least):
        """A value that the pushed filters let pass, a least step from an end that they may leave out; None without a range."""
        if self.low is None:
            return None if self.high is None else self.high - least
        return self.low if self.low == self.high else self.low + least

    def holds(self, value) -> bool:
        return not self.before(value) and not self.after(value)


def first_place(low: int, high: int, is_before: Callable[[int], bool]) -> int:
    """The first place from low on, below high, that is_before does not hold for; high if it holds for all.  Places are in order."""
    while low < high:
        mid = (low + high) // 2
        if is_before(mid):
            low = mid + 1
        else:
            high = mid
    return low


def allow_pushdown(spark: SparkSession) -> None:
    """Sources with pushed filters need this setting; without it Spark refuses to read them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
