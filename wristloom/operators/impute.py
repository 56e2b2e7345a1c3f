"""Filling missing epochs by the mean of the same time of day on other days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weekday(ts: Column | str) -> Column:
    """0 for Monday."""
    return F.weekday(ts)


def impute(epochs: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """values with nulls filled by the mean of the same minute of day: of the same weekday, else of
    weekdays or weekends, else of all days.

    The steps are sequential: the means of a step include what the step before has filled.  A minute of day
    without any value stays null.
    """
    minute = [F.hour(ts).alias("_h"), F.minute(ts).alias("_m")]
    out = epochs.select("*", weekday(ts).alias("_d"), (weekday(ts) >= 5).alias("_w"), *minute)
    for keys in (["_d", "_h", "_m"], ["_w", "_h", "_m"], ["_h", "_m"]):
        by = Window.partitionBy(key, *keys)
        out = out.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(by)) for c in values})
    return out.drop("_d", "_w", "_h", "_m")


def group_mean_fill(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """values with nulls filled by the mean of their key."""
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(Window.partitionBy(key))) for c in values})
