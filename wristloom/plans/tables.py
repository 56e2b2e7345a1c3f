"""The given tables seen as recordings, and tidy results.

A user of `events` is a recording, its values are activity in mg; a supplier of `lineitem` is a device whose
quantity, discount and tax stand for the three axes; a label's quality and toxic stand for truth and prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = 21600  # events are sparse: six-hour epochs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, places: int = 9) -> DataFrame:
    """Floating columns rounded, whole numbers as 64-bit: engines differ in summation order and in widths."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as six-hour epochs: user_id, time, acc (mean value), n."""
    e = table(spark, sf_dir, "events")
    start = (F.timestamp_micros(F.expr(f"unix_micros(cast(ts as timestamp)) div {PERIOD * 1_000_000} * {PERIOD * 1_000_000}"))).cast("timestamp_ntz")
    return e.groupBy("user_id", start.alias("time")).agg(F.avg("value").alias("acc"), F.count("*").alias("n"))


EPOCHS = f"""epochs AS (
  SELECT user_id, make_timestamp(epoch_us(ts) // {PERIOD * 1_000_000} * {PERIOD * 1_000_000}) AS time, avg(value) AS acc, count(*) AS n FROM events GROUP BY ALL)"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples of a device: key, ordering columns, and axes in g."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("device"), "l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 25).alias("x"), (F.col("l_discount") * 10 - 0.5).alias("y"), (F.col("l_tax") * 10 - 0.4).alias("z"))


AXES = """samples AS (
  SELECT l_suppkey AS device, l_orderkey, l_linenumber, (l_quantity - 25) / 25 AS x, l_discount * 10 - 0.5::DOUBLE AS y, l_tax * 10 - 0.4::DOUBLE AS z FROM lineitem)"""
