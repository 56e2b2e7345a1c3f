"""Circadian metrics of a regular series: power at one cycle a day, dominant frequency, M10 and L5."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .epochs import seconds_between


def sleep_signal(labels: list[str], sleep: str = "sleep") -> Column:
    """1 where sleep is the first of the largest label columns, else -1."""
    at = labels.index(sleep)
    best = F.lit(True)
    for k, c in enumerate(labels):
        if k != at:
            best = best & ((F.col(sleep) > F.col(c)) if k < at else (F.col(sleep) >= F.col(c)))
    return F.when(best, 1.0).otherwise(-1.0)


def numbered(df: DataFrame, key: str, ts: str, signal: Column) -> DataFrame:
    """key, signal, its place t in time order from 0, and the series' length n."""
    by = Window.partitionBy(key)
    return df.select(key, signal.cast("double").alias("signal"), (F.row_number().over(by.orderBy(ts)) - 1).alias("t"), F.count("*").over(by).alias("n"))


def power(series: DataFrame, key: str, cycles: Column) -> DataFrame:
    """Squared magnitude of the Fourier coefficient at `cycles` per series, as two plain sums."""
    angle = -2 * math.pi * cycles * F.col("t") / F.col("n")
    re, im = F.sum(F.col("signal") * F.cos(angle) / F.col("n")), F.sum(F.col("signal") * F.sin(angle) / F.col("n"))
    return series.groupBy(key).agg((re * re + im * im).alias("psd"))


def daily_power(df: DataFrame, key: str, ts: str, signal: Column, period: float) -> DataFrame:
    """Power at one cycle per day of a regular series."""
    return power(numbered(df, key, ts, signal), key, F.col("n") * period / 86400)


def dominant_frequency(df: DataFrame, key: str, ts: str, signal: Column, period: float, refine: bool = True) -> DataFrame:
    """The most prominent frequency of each series, in cycles per day, by FFT and a parabolic-section refinement.

    Grouped by recording: a series is one recording's epochs (20,000 a week), which a transform needs whole.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["signal"].to_numpy()
        n = len(x)
        if n < 2:
            return pd.DataFrame({key: pdf[key].head(1), "frequency": [np.nan]})
        best = float(np.argmax(np.abs(np.fft.rfft(x))[1:]) + 1)  # the upper half mirrors the lower
        steps = np.arange(n) / n
        value = lambda k: -abs(np.sum(np.exp(-2j * np.pi * k * steps) * x) / n)
        if refine:
            best = brent(value, best - 1, best, best + 1)
        return pd.DataFrame({key: pdf[key].head(1), "frequency": [best / (n * period / 86400)]})

    series = numbered(df, key, ts, signal)
    return series.groupBy(key).applyInPandas(one, f"{key} {series.schema[key].dataType.simpleString()}, frequency double")


def brent(f, low: float, start: float, high: float, tolerance: float = 1e-9, rounds: int = 100) -> float:
    """A local minimum of f in a bracket, by parabolas through three points and golden sections (Brent, 1973)."""
    golden = (3 - math.sqrt(5)) / 2
    a, b = low, high
    x = w = v = start
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(rounds):
        mid, tol = (a + b) / 2, tolerance * abs(x) + 1e-12
        if abs(x - mid) <= 2 * tol - (b - a) / 2:
            break
        parabola = None
        if abs(before) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            top, bottom = (x - v) * q - (x - w) * r, 2 * (q - r)
            if bottom > 0:
                top = -top
            bottom = abs(bottom)
            if abs(top) < abs(bottom * before / 2) and bottom * (a - x) < top < bottom * (b - x):
                parabola = top / bottom
        if parabola is None:
            before = (b if x < mid else a) - x
            step = golden * before
        else:
            before, step = step, parabola
        u = x + (step if abs(step) >= tol else math.copysign(tol, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def m10_l5(df: DataFrame, key: str, ts: str, value: str, period: float) -> DataFrame:
    """Means of the most active ten and least active five hours per whole day from the start, and their relative amplitude.

    A day's last full window is left out, as are days after the last whole one; recordings under a day give null.
    """
    first, last = F.min(ts).over(Window.partitionBy(key)), F.max(ts).over(Window.partitionBy(key))
    day = F.floor(seconds_between(F.col(ts), first) / 86400)
    cut = df.select(key, ts, F.col(value).alias("v"), day.alias("day"), F.floor(seconds_between(last, first) / 86400).alias("days"))
    order = Window.partitionBy(key, "day").orderBy(ts)
    ten, five = int(10 * 3600 / period), int(5 * 3600 / period)
    whole = cut.where("day < days").withColumns({
        "ten": F.sum("v").over(order.rowsBetween(0, ten - 1)), "five": F.sum("v").over(order.rowsBetween(0, five - 1)),
        "row": F.row_number().over(order), "size": F.count("*").over(Window.partitionBy(key, "day")),
    })
    days = whole.groupBy(key, "day").agg(
        (F.max(F.when(F.col("row") <= F.col("size") - ten, F.col("ten"))) / ten).alias("m"), (F.min(F.when(F.col("row") <= F.col("size") - five, F.col("five"))) / five).alias("l")
    )
    out = days.groupBy(key).agg(F.avg("m").alias("m10"), F.avg("l").alias("l5"))
    return out.withColumn("relative_amplitude", (F.col("m10") - F.col("l5")) / (F.col("m10") + F.col("l5")))
