"""Summary metrics of epoch tables: daily hours, distributions, and means of means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .impute import weekday

DAY_NAMES = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: 1 mg steps to 20, 5 mg to 100, 25 mg to 500, 100 mg to 2000.
ECDF_LEVELS = (*range(1, 21), *range(25, 101, 5), *range(125, 501, 25), *range(600, 2001, 100))


def daily_hours(epochs: DataFrame, key: str, ts: str, columns: list[str], period: float) -> DataFrame:
    """Per calendar day, numbered from 0: the hours that each 0/1 column adds up to."""
    days = epochs.groupBy(key, F.to_date(ts).alias("day")).agg(*((F.sum(F.col(c).cast("double")) * period / 3600).alias(f"{c}_hours") for c in columns))
    return days.withColumn("day_number", (F.dense_rank().over(Window.partitionBy(key).orderBy("day")) - 1).cast("long"))


def exclude_days(epochs: DataFrame, key: str, ts: str, values: list[str], worn: Column, period: float, least_hours: float) -> DataFrame:
    """values set to null on calendar days with less than least_hours of wear; adds included."""
    hours = F.sum(worn.cast("int")).over(Window.partitionBy(key, F.to_date(ts))) * period / 3600
    out = epochs.withColumn("included", hours >= least_hours)
    return out.withColumns({c: F.when(F.col("included"), F.col(c)) for c in values})


def overall(epochs: DataFrame, key: str, values: list[str]) -> DataFrame:
    return epochs.groupBy(key).agg(*(f(c).alias(f"{c}_{n}") for c in values for f, n in ((F.avg, "avg"), (F.stddev_samp, "sd"))))


def weekday_hour_cube(epochs: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """The mean of each weekday (0: Monday) and hour: the cells that all roll-ups average."""
    return epochs.groupBy(key, weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(*(F.avg(c).alias(c) for c in values))


def mean_of_means(cube: DataFrame, key: str, value: str) -> DataFrame:
    """(key, metric, value) in long form: week, weekday, hour of day, and weekday or weekend averages of the cube.

    One explode of each cell to the metrics it belongs to, and one aggregation.
    """
    d, h = F.col("weekday"), F.col("hour").cast("string")
    part = F.when(d >= 5, "weekend").otherwise("weekday")
    cap = F.when(d >= 5, "Weekend").otherwise("Weekday")
    names = F.array(
        F.lit(f"{value}-week-avg"), F.concat(F.lit(f"{value}-"), F.get(F.array(*map(F.lit, DAY_NAMES)), d), F.lit("-avg")),
        F.concat(F.lit(f"{value}-hourOfDay-"), h, F.lit("-avg")), F.concat(F.lit(f"{value}-"), part, F.lit("-avg")),
        F.concat(F.lit(f"{value}-hourOf"), cap, F.lit("-"), h, F.lit("-avg")),
    )
    return cube.select(key, F.col(value).alias("v"), F.explode(names).alias("metric")).groupBy(key, "metric").agg(F.avg("v").alias("value"))


def summary_map(long: DataFrame, key: str) -> DataFrame:
    """Metrics in long form (key, metric, value) as one map per recording."""
    return long.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def ecdf(epochs: DataFrame, key: str, ts: str, value: str, levels=ECDF_LEVELS, legacy: bool = False) -> DataFrame:
    """Share of epochs at or below each level: first per minute of day, then over minutes.

    Missing epochs count for nothing; with legacy they count as below every level.
    """
    v = F.col(value)
    below = lambda x: F.when(v.isNull(), F.lit(1.0) if legacy else F.lit(None).cast("double")).otherwise((v <= x).cast("double"))
    # a column per level: an epoch is one row in one aggregation, and so is a minute of day
    minutes = epochs.groupBy(key, F.hour(ts).alias("h"), F.minute(ts).alias("m")).agg(*(F.avg(below(x)).alias(f"p{k}") for k, x in enumerate(levels)))
    wide = minutes.groupBy(key).agg(*(F.avg(f"p{k}").alias(f"p{k}") for k in range(len(levels))))
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(f"p{k}").alias("ecdf")) for k, x in enumerate(levels))))
    return wide.select(key, cells.alias("c")).select(key, "c.level", "c.ecdf")


def quality(epochs: DataFrame, key: str, ts: str, zone: str) -> DataFrame:
    """Totals of raw samples and clips, and the sign of a change of the zone's offset between first and last epoch.

    ts is a UTC instant.
    """
    off = lambda c: F.unix_micros(F.from_utc_timestamp(c, zone)) - F.unix_micros(c)
    t = F.col(ts).cast("timestamp")
    return epochs.groupBy(key).agg(
        F.sum("rawSamples").alias("total_reads"), F.sum("clipsBeforeCalibr").alias("clips_before"), F.sum("clipsAfterCalibr").alias("clips_after"),
        F.signum(off(F.max(t)) - off(F.min(t))).cast("int").alias("dst_crossover"),
    )


def wide(long: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Chosen metrics of long form as columns."""
    return long.groupBy(key).pivot("metric", metrics).agg(F.first("value"))


def rolling_mean(df: DataFrame, key: str, ts: str, value: str, seconds: float) -> Column:
    """Trailing mean over a time window, open at its early end."""
    wide_us = int(seconds * 1_000_000) - 1
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.avg(value).over(Window.partitionBy(key).orderBy(t).rangeBetween(-wide_us, 0))


def rolling_median(df: DataFrame, key: str, ts: str, value: str, k: int) -> DataFrame:
    """The median of k rows from each row on, for full windows only."""
    order = Window.partitionBy(key).orderBy(ts)
    w = order.rowsBetween(0, k - 1)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == k).drop("_n")


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
