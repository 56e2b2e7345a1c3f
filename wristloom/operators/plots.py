"""What a day-by-day plot of a labelled series shows, as a table; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .epochs import nearest_regrid
from .summarise import rolling_mean

MOST = 2000.0  # mg


def panels(series: DataFrame, key: str, ts: str, labels: list[str], period: int, first_days: int | None = None, smooth_seconds: float = 60) -> DataFrame:
    """key, time, day (a panel each), acc (one-minute mean, cut to 0-2000) and labels scaled to 0-2000.

    series has acc, imputed and the labels.  Imputed epochs show no acc and no label; times that the series lacks
    take the nearest epoch within a period.
    """
    cut = series
    if first_days is not None:
        start = F.min(ts).over(Window.partitionBy(key))
        cut = cut.withColumn("_a", start).where(F.col(ts) < F.col("_a") + F.expr(f"interval {first_days} days")).drop("_a")
    even = nearest_regrid(cut.select(key, ts, "acc", "imputed", *labels), key, ts, period, period, whole_days=False)
    shown = ~F.coalesce(F.col("imputed"), F.lit(True))
    out = even.withColumn("acc", F.when(shown, F.col("acc"))).withColumns({c: F.when(shown, F.col(c) * MOST).otherwise(0.0) for c in labels})
    mean = F.greatest(F.least(rolling_mean(out, key, ts, "acc", smooth_seconds), F.lit(MOST)), F.lit(0.0))
    return out.select(key, ts, F.to_date(ts).alias("day"), F.when(F.col("acc").isNotNull(), mean).alias("acc"), *labels)
