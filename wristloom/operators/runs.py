"""Runs of equal values in time order: stationary bouts, non-wear, short streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .epochs import seconds_between


def runs(df: DataFrame, key: str, ts: str, value: Column) -> DataFrame:
    """Adds run: a number that rises with every change of value, per key in the order of ts (nulls are equal)."""
    order = Window.partitionBy(key).orderBy(ts)
    changed = F.when(F.lag("_value").over(order).eqNullSafe(F.col("_value")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    out = df.withColumn("_value", value).withColumn("_changed", changed)
    return out.withColumn("run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_value", "_changed")


def stationary(stds: list[str], tolerance: float) -> Column:
    """All deviations below the tolerance; never where one is null."""
    out = F.lit(True)
    for c in stds:
        out = out & F.coalesce(F.col(c) < tolerance, F.lit(False))
    return out


def nonwear_bouts(epochs: DataFrame, key: str, ts: str, still: Column, patience_mins: float) -> DataFrame:
    """Bouts of still epochs whose first and last are more than patience_mins apart: start, end, n."""
    marked = runs(epochs.withColumn("_still", still), key, ts, F.col("_still"))
    found = marked.where("_still").groupBy(key, "run").agg(F.min(ts).alias("bout_start"), F.max(ts).alias("bout_end"), F.count("*").alias("n_epochs"))
    return found.where(seconds_between(F.col("bout_end"), F.col("bout_start")) > 60 * patience_mins).drop("run")


def mask_nonwear(epochs: DataFrame, key: str, ts: str, still: Column, patience_mins: float) -> DataFrame:
    """epochs, which have a boolean missing, with it also true in non-wear bouts, and all values null where it is true."""
    marked = runs(epochs.withColumn("_still", still), key, ts, F.col("_still"))
    by = Window.partitionBy(key, "run")
    long = F.col("_still") & (seconds_between(F.max(ts).over(by), F.min(ts).over(by)) > 60 * patience_mins)
    out = marked.withColumn("_missing", F.coalesce(F.col("missing"), F.lit(False)) | long)
    values = [c for c in epochs.columns if c not in (key, ts, "missing")]
    return out.select(key, ts, *(F.when(~F.col("_missing"), F.col(c)).alias(c) for c in values), F.col("_missing").alias("missing"))


def wear_time(epochs: DataFrame, key: str, ts: str, period: float) -> DataFrame:
    """Per recording: wear and non-wear days, and good_wear: three days of wear, and some in every hour of day there is."""
    days = period / 86400
    hours = epochs.groupBy(key, F.hour(ts).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("missing").cast("int")).alias("gone"))
    return hours.groupBy(key).agg(
        (F.sum(F.col("n") - F.col("gone")) * days).alias("wear_days"), (F.sum("gone") * days).alias("nonwear_days"),
        ((F.sum(F.col("n") - F.col("gone")) * days >= 3) & ~F.bool_or(F.col("n") == F.col("gone"))).cast("int").alias("good_wear"),
    )


def relabel_short_streaks(df: DataFrame, key: str, ts: str, label: str, target: str, replacement: str, least: float) -> DataFrame:
    """label, with streaks of target of fewer than `least` rows replaced."""
    marked = runs(df, key, ts, F.col(label))
    size = F.count("*").over(Window.partitionBy(key, "run"))
    new = F.when((F.col(label) == target) & (size < least), F.lit(replacement)).otherwise(F.col(label))
    return marked.withColumn("_new", new).withColumn(label, F.col("_new")).drop("_new", "run")
