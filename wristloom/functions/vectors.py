"""Column functions on acceleration vectors, in g."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def enmo(x: Column, y: Column, z: Column) -> Column:
    """Euclidean norm minus one."""
    return magnitude(x, y, z) - 1.0


def truncated(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def angle_degrees(x: Column, y: Column, z: Column) -> Column:
    """Arm angle; the squares under z are summed without a root, as trained models expect."""
    return F.degrees(F.atan(z / (x * x + y * y)))


def calibrated(v: Column, temp: Column, offset: Column, slope: Column, temp_slope: Column) -> Column:
    return offset + v * slope + temp * temp_slope


def clip_flags(raw: tuple[Column, ...], fixed: tuple[Column, ...], limit: float) -> tuple[Column, Column]:
    """Whether a sample was at the sensor's limit, and whether calibration alone has put it beyond."""
    before = F.greatest(*map(F.abs, raw)) >= limit
    after = (F.greatest(*map(F.abs, fixed)) > limit) & ~before
    return before, after


def clamped(raw: Column, fixed: Column, before: Column, limit: float) -> Column:
    """Within the limit; a sample that was clipped stays at the limit on its own side."""
    bounded = F.greatest(F.least(fixed, F.lit(limit)), F.lit(-limit))
    return F.when(before & (F.abs(raw) >= limit), F.signum(raw) * limit).otherwise(bounded)


def hann(signal: Column) -> Column:
    """An array times the Hann window of its length."""
    # a lambda's variable holds the array, so that its length is not worked out for each element
    return F.transform(F.array(signal), lambda s: F.transform(s, lambda v, i: v * (0.5 - 0.5 * F.cos(2 * math.pi * i / (F.size(s) - 1)))))[0]


def unit(*axes: Column) -> list[Column]:
    """The axes divided by the vector's length."""
    length = F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))
    return [a / length for a in axes]


def running_deviation(values: Column) -> Column:
    """Population deviation of an array's numbers, updated value by value in its order; nulls are passed over.

    Aggregates over rows sum in an order of their own; where a limit equals a deviation that values can have, the last bit decides.
    """
    none = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mean", "squares")))

    def add(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (v - a["mean"]) / n
        return F.when(v.isNull(), a).otherwise(F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (v - mean) * (v - a["mean"])).alias("squares")))

    return F.aggregate(values, none, add, lambda a: F.when(a["n"] > 0, F.sqrt(a["squares"] / a["n"])))
