"""Streaming queries over the events table, each drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import epochs as streams, gaps
from .signal_queries import A, B
from .signal_queries import SQL as SIGNAL_SQL
from .tables import PERIOD, table, tidy

QUERIES, SQL = {}, {}


def _events(spark, sf_dir):
    return streams.read_table(spark, f"{sf_dir}/", "events.parquet", table(spark, sf_dir, "events").schema)


def stream_epochs(spark, sf_dir):
    return tidy(streams.drained(streams.tumbling(_events(spark, sf_dir), "user_id", "ts", "value", PERIOD), "stream-epochs"))


def stream_filter(spark, sf_dir):
    return tidy(streams.drained(streams.filtered(_events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "event_id", "value", B, A), "stream-filter"))


def gap_samples(spark, sf_dir, events):
    """events as samples that come in the order of their ids, a day of them in 600 seconds: many come late, and gaps are long."""
    t = F.timestamp_micros(F.expr("cast(unix_micros(cast(ts as timestamp)) / 144 as bigint)")).cast("timestamp_ntz")
    axes = [(F.col("value") / 250).alias("x"), (F.col("event_id") % 7 / 7.0).alias("y"), F.lit(0.1).alias("z")]
    return events.select("user_id", "event_id", t.alias("t"), *axes, F.lit(20.0).alias("temp"), (F.col("value") > 240).alias("clip_before"), F.lit(False).alias("clip_after"))


def stream_gap_epochs(spark, sf_dir):
    """Epochs of two minutes on a grid that lags behind, with late samples and gaps counted as errors."""
    samples = gap_samples(spark, sf_dir, _events(spark, sf_dir))
    found = gaps.gap_epochs(samples, "user_id", "event_id", period=120, rate=10, low_pass=4.0, least=2)
    return tidy(streams.drained(found, "stream-gap-epochs", rocksdb=True))


QUERIES |= {"stream_gap_epochs": stream_gap_epochs}
QUERIES |= {"stream_epochs": stream_epochs, "stream_filter": stream_filter}
SQL["stream_epochs"] = f"""WITH w AS (SELECT user_id, make_timestamp(epoch_us(ts) // {PERIOD * 1_000_000} * {PERIOD * 1_000_000}) AS epoch_start, value, max(epoch_us(ts)) OVER () AS latest FROM events)
SELECT user_id, epoch_start, count(*) AS n, round(avg(value), 9) AS mean, round(min(value), 9) AS low, round(max(value), 9) AS high FROM w
WHERE epoch_us(epoch_start) + {PERIOD * 1_000_000} <= latest GROUP BY user_id, epoch_start"""
SQL["stream_filter"] = SIGNAL_SQL["butterworth_lowpass"]

