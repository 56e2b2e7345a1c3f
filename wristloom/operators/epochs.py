"""Epochs: fixed time windows of a recording, their gaps, and the regular grid.

Built from aggregations and window functions, keyed by the recording.  Times are TIMESTAMP_NTZ or
TIMESTAMP; periods are in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import scan

#: Recordings whose first samples are broadcast, a key and two numbers each; more are joined by key and hour.
FEW = 200_000
HOUR = 3_600_000_000


def micros(ts: Column | str) -> Column:
    """A time as microseconds; local times count as if they were UTC, which leaves differences as they are."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def latest_before(samples: DataFrame, key: str, ts: str, arrival: str, width: float | None = None) -> DataFrame:
    """samples with _seen: the latest time of those of their recording that have come, by arrival, before them.

    A recording is cut into chunks of arrivals of that width, so its samples need not meet in one task.
    """
    return scan.greatest_before(samples, key, arrival, ts, "_seen", width or scan.width_of(samples, key, arrival))


def in_order(samples: DataFrame, key: str, ts: str, arrival: str, width: float | None = None) -> DataFrame:
    """samples without those that come, by arrival, after a later one of their recording."""
    seen = latest_before(samples, key, ts, arrival, width)
    return seen.where(F.col("_seen").isNull() | (F.col(ts) >= F.col("_seen"))).drop("_seen")


def anchored(samples: DataFrame, key: str, ts: str, period: float, start: Column | None = None, few: int = FEW) -> DataFrame:
    """Adds epoch (number) and epoch_start: windows that begin at the recording's first sample, or at start.

    First samples are a row per recording, summed map-side into a written table.  Up to `few` of them are broadcast, and samples
    stay where they are; more meet the samples by recording and hour, so a recording's samples never meet in one task.
    """
    t = micros(ts)
    step = int(period * 1_000_000)
    out = samples.withColumn("_t", t)
    if start is not None:
        out = out.withColumn("_first", micros(start))
    else:
        firsts = written(samples.groupBy(F.col(key).alias("_key")).agg(F.min(t).alias("_first"), F.max(t).alias("_last")).where("_first IS NOT NULL"), "first-samples")
        same = F.col(key).eqNullSafe(F.col("_key"))
        if firsts.count() <= few:
            out = out.join(F.broadcast(firsts), same).drop("_key", "_last")
        else:
            hours = firsts.select("_key", "_first", F.explode(F.expr(f"sequence(_first div {HOUR}, _last div {HOUR})")).alias("_of"))
            out = out.withColumn("_hour", F.expr(f"_t div {HOUR}")).join(hours, same & (F.col("_hour") == F.col("_of"))).drop("_key", "_of", "_hour")
    out = out.where("_t >= _first")
    number = F.expr(f"(_t - _first) div {step}")
    return out.withColumn("epoch", number).withColumn("epoch_start", F.timestamp_micros(F.col("_first") + number * step).cast(samples.schema[ts].dataType)).drop("_t", "_first")


def epoch_statistics(samples: DataFrame, key: str, ts: str, value: str, period: float, least: int = 0, drop_open: bool = False) -> DataFrame:
    """Count, mean, range and deviations of value per anchored epoch.

    Epochs of `least` samples or fewer are left out; drop_open leaves out each recording's last epoch, which
    no later sample has closed.
    """
    cut = anchored(samples, key, ts, period)
    v = F.col(value)
    out = cut.groupBy(key, "epoch", "epoch_start").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("range"),
        F.stddev_pop(v).alias("std"), F.stddev_samp(v).alias("std_r"),
    )
    if drop_open:
        out = out.withColumn("_last", F.max("epoch").over(Window.partitionBy(key))).where("epoch < _last").drop("_last")
    return out.where(F.col("n") > least)


def interrupts(epochs: DataFrame, key: str, ts: str, period: float) -> DataFrame:
    """Per recording, the number of gaps longer than a period, and their minutes (whole differences)."""
    gap = seconds_between(F.col(ts), F.lag(ts).over(Window.partitionBy(key).orderBy(ts)))
    long = epochs.select(key, gap.alias("gap"))
    return long.groupBy(key).agg(
        F.sum(F.when(F.col("gap") > period, 1).otherwise(0)).cast("long").alias("interrupts_num"),
        (F.coalesce(F.sum(F.when(F.col("gap") > period, F.col("gap"))), F.lit(0.0)) / 60).alias("interrupt_mins"),
    )


def grid(epochs: DataFrame, key: str, ts: str, period: int, whole_days: bool = False) -> DataFrame:
    """Every time of a regular grid from a recording's first to its last epoch, or over its whole local days."""
    ends = epochs.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    step = F.expr(f"interval {period} seconds")
    if whole_days:
        day = F.date_trunc("day", b).cast(epochs.schema[ts].dataType)
        up = F.when(day == b, b).otherwise(day + F.expr("interval 1 day"))
        a, b = F.date_trunc("day", a).cast(epochs.schema[ts].dataType), up - step
    return ends.select(key, F.explode(F.sequence(a, b, step)).alias(ts))


def regrid(epochs: DataFrame, key: str, ts: str, period: int) -> DataFrame:
    """epochs on the regular grid, with a boolean missing: any value column is null there."""
    values = [c for c in epochs.columns if c not in (key, ts)]
    out = grid(epochs, key, ts, period).join(epochs, [key, ts], "left")
    missing = F.lit(False)
    for c in values:
        missing = missing | F.col(c).isNull()
    return out.withColumn("missing", missing)


def nearest_regrid(epochs: DataFrame, key: str, ts: str, period: int, tolerance: float, whole_days: bool = True) -> DataFrame:
    """The grid with the values of each time's nearest epoch within tolerance seconds; ties go to the earlier one.

    Epochs meet grid points in buckets as wide as the tolerance and their neighbours, an equi-join.
    """
    values = [c for c in epochs.columns if c not in (key, ts)]
    wide = int(tolerance * 1_000_000)
    bucket = F.expr(f"_t div {wide}")
    points = grid(epochs, key, ts, period, whole_days).withColumn("_t", micros(ts)).withColumn("_b", bucket)
    have = epochs.withColumn("_t", micros(ts)).withColumn("_bucket", bucket)
    near = have.select(key, F.col("_t").alias("_u"), F.struct(*values).alias("_v"), F.explode(F.array(*(F.col("_bucket") + d for d in (-1, 0, 1)))).alias("_b"))
    pairs = points.join(near, [key, "_b"]).where(F.abs(F.col("_t") - F.col("_u")) <= wide)
    best = pairs.groupBy(key, ts).agg(F.min_by("_v", F.struct(F.abs(F.col("_t") - F.col("_u")), F.col("_u"))).alias("_v"))
    return points.select(key, ts).join(best, [key, ts], "left").select(key, ts, *(F.col(f"_v.{c}").alias(c) for c in values))


def interpolate(samples: DataFrame, points: DataFrame, key: str, ts: str, value: str, nearest: bool = False, width: float | None = None) -> DataFrame:
    """points (key, ts) with value interpolated between each one's neighbours in samples; end values are held.

    Linear, or the nearer neighbour's value (ties: the earlier one).  Both tables are ordered together in chunks of
    width microseconds (by default what scan.width_of finds) and the neighbours carried along, over chunks too.
    """
    t = micros(ts)
    both = samples.select(key, t.alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_p")).unionByName(
        points.select(key, t.alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_p"))
    )
    known = F.when(F.col("_p") == 0, F.struct("_t", "_v"))
    width = width or scan.width_of(both, key, "_t")
    out = scan.carried(both, key, "_t", {"a": known}, width, ties=F.col("_p"))
    out = scan.carried(out, key, "_t", {"b": known}, width, ahead=True, ties=F.desc("_p")).where("_p = 1")
    t, a, b = F.col("_t"), F.col("a"), F.col("b")
    if nearest:
        mid = F.when(t - a["_t"] <= b["_t"] - t, a["_v"]).otherwise(b["_v"])
    else:
        mid = F.when(a["_t"] == b["_t"], a["_v"]).otherwise(a["_v"] + (b["_v"] - a["_v"]) * (t - a["_t"]) / (b["_t"] - a["_t"]))
    held = F.when(a.isNull(), b["_v"]).when(b.isNull(), a["_v"]).otherwise(mid)
    return out.select(key, F.timestamp_micros("_t").cast(points.schema[ts].dataType).alias(ts), held.alias(value))
