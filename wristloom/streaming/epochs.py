"""Epochs of unbounded sample streams, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.signal import iir
from ..sources.shared import shared_path


def tumbling(samples: DataFrame, key: str, ts: str, value: str, period: int, late: str = "0 seconds", start: str = "0 seconds", least: int = 0) -> DataFrame:
    """Closed epochs of a stream: n, mean, low and high per key and window.

    An epoch is emitted when the watermark, the latest time less `late`, passes its end; samples older than that are
    dropped, and an epoch that nothing closes is not emitted.
    """
    t = F.col(ts).cast("timestamp")
    timed = samples.withColumn("_t", t).withWatermark("_t", late)
    out = timed.groupBy(key, F.window("_t", f"{period} seconds", f"{period} seconds", start).alias("w")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return out.where(F.col("n") > least).select(key, F.col("w.start").cast("timestamp_ntz").alias("epoch_start"), "n", "mean", "low", "high")


def filtered(samples: DataFrame, key: str, order: str, value: str, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """A stream's values through an IIR filter whose state is carried from batch to batch, per key."""
    kind = samples.schema[key].dataType.simpleString()
    order_kind = samples.schema[order].dataType.simpleString()

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(order)
        before = np.array(state.get[0], dtype=float) if state.exists else None
        y, z = iir(b, a, pdf[value].to_numpy(dtype=float), before)
        state.update((z.tolist(),))
        yield pdf[[key, order]].assign(filtered=y)

    narrow = samples.select(key, order, value)
    return narrow.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {order_kind}, filtered double", "z array<double>", "append", "NoTimeout")


def read_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A folder's Parquet files of that name as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)


#: The state store that transformWithState needs (rocksdb=True).
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream: DataFrame, label: str, rocksdb: bool = False) -> DataFrame:
    """All that a stream gives for what there is now, written exactly once to the shared folder and read back."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(STORE[0], None)
    if rocksdb:
        spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if rocksdb:
            spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(stream.schema).parquet(path)
