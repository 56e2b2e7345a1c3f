"""Epochs of sample streams whose grid depends on all samples before: late samples, gaps, and a grid that lags behind.

A recording's samples come in the order of their arrival.  An epoch closes with the first sample at or past its end, but only if it
holds more than `least` samples, so after a gap of one to two periods the grid lags and catches up with short epochs; a
gap of two periods or more closes the epoch at once (or drops it, if it holds too few) and moves the grid on.  Samples
that come after a later one are left out.  Both count as errors of the epoch that is open then.  None of this can be said by
a sample's time alone, so it is a stateful processor per recording, whose state is the open epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signal import BASIC, FEATURES, TAIL, basic_statistics, butterworth, features, iir

COLUMNS = ("x", "y", "z", "temp", "before", "after")
STATE = "start long, prev long, last array<double>, errors long, t array<long>, held array<array<double>>, z array<double>"


@dataclass
class OpenEpoch:
    """The epoch of a recording that is open; times are microseconds, held has a column for each of COLUMNS."""

    start: int | None = None
    prev: int | None = None
    last: np.ndarray = field(default_factory=lambda: np.zeros(len(COLUMNS)))
    errors: int = 0
    t: list[np.ndarray] = field(default_factory=list)
    held: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, t: np.ndarray, rows: np.ndarray) -> None:
        self.t.append(t)
        self.held.append(rows)
        self.size += len(t)

    def taken(self) -> tuple[int, np.ndarray, np.ndarray, int]:
        """(start, times, rows, errors) of the epoch, which is empty then; times count from its start."""
        out = self.start, np.concatenate(self.t) - self.start, np.concatenate(self.held), self.errors
        self.t, self.held, self.size, self.errors = [], [], 0, 0
        return out


def closed(state: OpenEpoch, t: np.ndarray, rows: np.ndarray, period: int, least: int, edges: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Epochs that samples (t, rows), in order of arrival, close.  Work is by stretches without an event, not by sample.

    With edges, a closing sample also ends the epoch it closes, and the sample before it begins the next one, for interpolation.
    """
    before = np.maximum.accumulate(np.concatenate([[state.prev if state.prev is not None else np.iinfo(np.int64).min], t]))[:-1]
    late = t < before
    late_upto = np.cumsum(late)[~late]  # late samples that came before each one that is kept
    n_late, t, rows = int(late.sum()), t[~late], rows[~late]
    steps = np.diff(t, prepend=state.prev if state.prev is not None else t[:1])
    gaps = np.flatnonzero(steps >= 2 * period)
    i, seen, next_gap = 0, 0, 0
    if state.start is None and len(t):
        state.start = int(t[0])
    while i < len(t):
        while next_gap < len(gaps) and gaps[next_gap] < i:
            next_gap += 1
        gap = int(gaps[next_gap]) if next_gap < len(gaps) else len(t)
        close = max(int(np.searchsorted(t, state.start + period)), i + max(0, least + 1 - state.size))
        j = min(gap, close, len(t))
        if j > i:
            state.add(t[i:j], rows[i:j])
            state.prev, state.last = int(t[j - 1]), rows[j - 1]
        if j == len(t):
            break
        state.errors += int(late_upto[j]) - seen
        seen = int(late_upto[j])
        now = int(t[j])
        if j == gap:
            state.errors += 1
            if state.size > least:
                yield state.taken()
            else:
                state.t, state.held, state.size, state.errors = [], [], 0, 0
            if state.start < now - period:
                state.start += -(-(now - period - state.start) // period) * period
        if now - state.start >= period and state.size > least:
            if edges:
                state.add(t[j : j + 1], rows[j : j + 1])
            yield state.taken()
            state.start += period
            if edges:
                state.add(np.array([state.prev]), state.last[None, :])
        state.add(t[j : j + 1], rows[j : j + 1])
        state.prev, state.last = now, rows[j]
        i = j + 1
    state.errors += n_late - seen


def described(epoch: tuple[int, np.ndarray, np.ndarray, int], period: int, rate: int, with_features: bool, b, a, z: np.ndarray, resample: str = "linear") -> tuple[dict, np.ndarray]:
    """(statistics of a closed epoch, the filter's state after it)."""
    start, t, rows, errors = epoch
    count = period * rate
    at = np.round(np.arange(count) * 1000 / rate) * 1000.0
    if resample == "nearest":
        right = np.clip(np.searchsorted(t, at), 0, len(t) - 1)
        left = np.maximum(right - 1, 0)
        xyz = rows[np.where(np.abs(at - t[left]) <= np.abs(t[right] - at), left, right), :3]
    else:
        xyz = np.stack([np.interp(at, t, rows[:, k]) for k in range(3)], axis=1)
    enmo = np.sqrt((xyz**2).sum(axis=1)) - 1
    if b is not None:
        enmo, z = iir(b, a, enmo, z)
    out = {"time": start} | basic_statistics(xyz, enmo)
    if with_features:
        out |= features(xyz, np.maximum(enmo, 0), rate)
    stuck = sum(int(c.std() == 0 and abs(c.mean()) > 1.5) for c in xyz.T) * count
    return out | {
        "temp": float(rows[:, 3].mean()), "samples": count, "dataErrors": errors + stuck,
        "clipsBeforeCalibr": int(rows[:, 4].sum()), "clipsAfterCalibr": int(rows[:, 5].sum()), "rawSamples": len(t),
    }, z


class GapProcessor(StatefulProcessor):
    """handleInputRows gets a recording's samples of a micro-batch; its state is the open epoch and the filter's."""

    def __init__(self, key: str, names: list[str], period: int, rate: int, with_features: bool, low_pass: float | None, least: int, edges: bool, resample: str):
        self.key, self.names, self.period, self.rate, self.with_features = key, names, period, rate, with_features
        self.least, self.edges, self.resample = least, edges, resample
        self.b, self.a = butterworth(4, low_pass, rate) if low_pass and rate > 2 * low_pass else (None, None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        z, state = np.zeros(4), OpenEpoch()
        if self.state.exists():
            start, prev, last, errors, t, held, z = self.state.get()
            state = OpenEpoch(start, prev, np.array(last), errors)
            z = np.array(z)
            if t:
                state.add(np.array(t, dtype=np.int64), np.array(held, dtype=float).reshape(-1, len(COLUMNS)))
        out = []
        for epoch in closed(state, pdf["t"].to_numpy(dtype=np.int64), pdf[list(COLUMNS)].to_numpy(dtype=float), self.period * 1_000_000, self.least, self.edges):
            row, z = described(epoch, self.period, self.rate, self.with_features, self.b, self.a, z, self.resample)
            out.append({self.key: key[0]} | row)
        t, held = (np.concatenate(state.t).tolist(), np.concatenate(state.held).tolist()) if state.t else ([], [])
        self.state.update((state.start, state.prev, np.asarray(state.last).tolist(), state.errors, t, held, np.asarray(z).tolist()))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def gap_epochs(samples: DataFrame, key: str, arrival: str, period: int = 30, rate: int = 100, with_features: bool = False, low_pass: float | None = 20.0, least: int = 10, edges: bool = True, resample: str = "linear") -> DataFrame:
    """The columns of signal.epoch_features, of a stream of samples (key, t, x, y, z, temp, clip_before, clip_after, arrival).

    A recording's samples are taken in the order of arrival within a micro-batch, and as they are between micro-batches.  The last
    epoch stays open.  Needs the RocksDB state store; drained(rocksdb=True) sets it.  A sample with a null time or axis is left out.
    """
    names = [*BASIC, *(FEATURES if with_features else ()), *TAIL]
    t = F.unix_micros(F.col("t").cast("timestamp")).alias("t")
    axes = [F.col(c).cast("double").alias(c) for c in ("x", "y", "z")] + [F.coalesce(F.col("temp").cast("double"), F.lit(0.0)).alias("temp")]
    clips = [F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("double").alias(n) for c, n in (("clip_before", "before"), ("clip_after", "after"))]
    rows = samples.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(key, t, *axes, *clips, F.col(arrival).alias("arrival"))
    kinds = {n: "double" for n in names} | {n: "long" for n in TAIL[1:]}
    schema = f"`{key}` {samples.schema[key].dataType.simpleString()}, time long, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    processor = GapProcessor(key, [key, "time", *names], period, rate, with_features, low_pass, least, edges, resample)
    out = rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "none")
    return out.withColumn("time", F.timestamp_micros("time").cast(samples.schema["t"].dataType))

