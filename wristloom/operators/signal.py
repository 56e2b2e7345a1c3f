"""Epoch features of raw samples: calibrate, clamp, resample, filter and describe each epoch.

Groups are epochs, not recordings: each gets, besides its own samples, the neighbours that interpolation needs, so a week
of samples spreads over as many tasks as there are.  A task takes many epochs, or series, side by side.  A filter runs on through a recording all the same: its state at
the start of every epoch comes from a scan of affine maps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import calibrated, clamped, clip_flags
from . import scan
from .epochs import anchored, latest_before, micros

BASIC = ("enmoTrunc", "enmoAbs", "xMean", "yMean", "zMean", "xRange", "yRange", "zRange", "xStd", "yStd", "zStd", "xyCov", "xzCov", "yzCov")
FEATURES = (
    "mean", "sd", "coefvariation", "median", "min", "max", "25thp", "75thp", "autocorr", "corrxy", "corrxz", "corryz",
    "avgroll", "avgpitch", "avgyaw", "sdroll", "sdpitch", "sdyaw", "rollg", "pitchg", "yawg",
    "fmax", "pmax", "fmaxband", "pmaxband", "entropy", *(f"fft{k}" for k in range(1, 11)),
    "MAD", "MPD", "skew", "kurt", "avgArmAngel", "avgArmAngelAbsDiff", "f1", "p1", "f2", "p2", "f625", "p625", "totalPower",
)
TAIL = ("temp", "samples", "dataErrors", "clipsBeforeCalibr", "clipsAfterCalibr", "rawSamples")
EPS = 1e-8
#: Resampled samples of epochs that are described side by side.
CELLS = 1 << 18
EDGE_SAMPLES = 66  # of the epoch before, within which the sample for interpolation at the start is looked for


def butterworth(order: int, cut: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital low-pass Butterworth filter: analogue poles on a circle, bilinear transform."""
    warped = 2 * rate * np.tan(np.pi * min(cut, 0.999 * rate / 2) / rate)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (2 * rate + poles) / (2 * rate - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(order)).real
    return b * a.sum() / b.sum(), a


def band_butterworth(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a band-pass Butterworth filter of twice that order."""
    lo, hi = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    base = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * (hi - lo) / 2
    root = np.sqrt(base**2 - lo * hi + 0j)
    poles = np.concatenate([base + root, base - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    a = np.real(np.poly(z))
    b = np.poly(np.concatenate([np.ones(order), -np.ones(order)])).real
    at = np.exp(-2j * np.pi * np.sqrt(low * high) / rate * np.arange(2 * order + 1))
    return b / abs((b @ at) / (a @ at)), a


def _steps(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence itself (direct form II transposed), sample by sample."""
    z, out = z.copy(), np.empty(len(x))
    for k, v in enumerate(x):
        y = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y
        z[-1] = b[-1] * v - a[-1] * y
        out[k] = y
    return out, z


#: Samples that are filtered by one matrix product.
BLOCK = 64


@lru_cache(maxsize=16)
def _responses(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """What a block's output and end state are by its samples and by the state before it: four matrices."""
    b_, a_, n = np.array(b), np.array(a), len(a) - 1
    by_sample = [_steps(b_, a_, x, np.zeros(n)) for x in np.eye(BLOCK)]
    by_state = [_steps(b_, a_, np.zeros(BLOCK), z) for z in np.eye(n)]
    return tuple(np.array([r[k] for r in rows]) for rows in (by_sample, by_state) for k in (0, 1))


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filtered signal and the filter's state after it, a block of samples at a time."""
    b, a = b / a[0], a / a[0]
    z = np.zeros(len(a) - 1) if state is None else state
    full = len(x) // BLOCK
    out = np.empty(len(x))
    if full:
        out_x, end_x, out_z, end_z = _responses(tuple(b), tuple(a))
        blocks = np.asarray(x[: full * BLOCK], dtype=float).reshape(full, BLOCK)
        ends, before = blocks @ end_x, np.empty((full, len(z)))
        for k in range(full):
            before[k] = z
            z = z @ end_z + ends[k]
        out[: full * BLOCK] = (blocks @ out_x + before @ out_z).reshape(-1)
    out[full * BLOCK :], z = _steps(b, a, x[full * BLOCK :], z)
    return out, z


def _steps_many(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_steps() of the rows of x side by side."""
    z, out = z.copy(), np.empty(x.shape)
    for k, v in enumerate(x.T):
        y = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(v, b[1:-1]) - np.outer(y, a[1:-1])
        z[:, -1] = b[-1] * v - a[-1] * y
        out[:, k] = y
    return out, z


def iir_many(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """iir() of the rows of x side by side, each from its row of state.  Rows that are not finite go sample by sample: a block would spread a NaN back."""
    b, a = b / a[0], a / a[0]
    z = np.zeros((len(x), len(a) - 1)) if state is None else np.array(state, dtype=float)
    odd = ~np.isfinite(x).all(axis=1)
    if odd.any():
        out = np.empty(x.shape)
        out[odd], z[odd] = _steps_many(b, a, x[odd], z[odd])
        out[~odd], z[~odd] = iir_many(b, a, x[~odd], z[~odd])
        return out, z
    series, full = len(x), x.shape[1] // BLOCK
    out = np.empty(x.shape)
    if full:
        out_x, end_x, out_z, end_z = _responses(tuple(b), tuple(a))
        blocks = x[:, : full * BLOCK].reshape(series, full, BLOCK)
        ends, before = blocks @ end_x, np.empty((series, full, z.shape[1]))
        for k in range(full):
            before[:, k] = z
            z = z @ end_z + ends[:, k]
        out[:, : full * BLOCK] = (blocks @ out_x + before @ out_z).reshape(series, full * BLOCK)
    out[:, full * BLOCK :], z = _steps_many(b, a, x[:, full * BLOCK :], z)
    return out, z


def iir_series(b: np.ndarray, a: np.ndarray, x: np.ndarray, edges: np.ndarray, state: np.ndarray | None = None, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """iir() of series that lie one after the other and begin at edges, each from its row of state; those of like lengths go side by side.

    They are filled up with zeros at the end; with back at the beginning, where from rest zeros change nothing: then the states are those after them.
    One series alone is not filled up, and its state is the one after it.
    """
    if len(edges) == 2:
        found, z = iir_many(b, a, x[None, :], state)
        return found[0], z
    out, states = np.empty(len(x)), np.zeros((len(edges) - 1, len(a) - 1))
    sizes = -(-np.diff(edges) // BLOCK)
    for size in np.unique(sizes):
        n = int(size) * BLOCK
        alike, some = np.flatnonzero(sizes == size), max(1, CELLS // n)
        for k in range(0, len(alike), some):
            own = alike[k : k + some]
            first, last = edges[own][:, None], edges[own + 1][:, None]
            at = (last - n if back else first) + np.arange(n)
            inside = (at >= first) & (at < last)
            found, states[own] = iir_many(b, a, np.where(inside, x[np.clip(at, 0, len(x) - 1)], 0.0), None if state is None else state[own])
            out[at[inside]] = found[inside]
    return out, states


def step_matrix(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What one sample of 0 makes of the filter's state: state @ step_matrix."""
    return np.array([_steps(np.asarray(b) / a[0], np.asarray(a) / a[0], np.zeros(1), z)[1] for z in np.eye(len(a) - 1)])


def filter_starts(n: np.ndarray, end: np.ndarray, step: np.ndarray, powers: dict[int, np.ndarray]) -> np.ndarray:
    """The filter's state at the start of chunks in order: n samples turn a state z into z step^n + end.

    end is the state after the chunk from a state of zero.  powers keeps those of step.
    """
    z, out = np.zeros(len(step)), np.empty(end.shape)
    for k, m in enumerate(n.tolist()):
        out[k] = z
        if k + 1 < len(n):
            if m not in powers:
                powers[m] = np.linalg.matrix_power(step, m)
            z = z @ powers[m] + end[k]
    return out


def starts(ends: DataFrame, key: str, order: str, step: np.ndarray) -> DataFrame:
    """(key, order, start, before) of ends (key, order, n, end): the filter's state at the start of each chunk, and the samples until there.

    A task goes through many recordings, and holds a row for each chunk of one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict[int, np.ndarray] = {}
        for table, edges in scan.whole_keys(batches, key):
            n, end = table.column("n").to_numpy(), scan.matrix(table.column("end"), len(step))
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            found = np.concatenate([filter_starts(n[i:j], end[i:j], step, powers) for i, j in parts])
            before = np.concatenate([np.cumsum(n[i:j]) - n[i:j] for i, j in parts])
            out = table.select([key, order]).append_column("start", scan.arrays(found)).append_column("before", pa.array(before, pa.int64()))
            yield from out.combine_chunks().to_batches()

    return ends.repartition(key).sortWithinPartitions(key, order).mapInArrow(task, f"{scan.kinds(ends, key, order)}, start array<double>, before long")


def filtered(df: DataFrame, key: str, order: str, value: str, b: np.ndarray, a: np.ndarray, width: float | None = None) -> DataFrame:
    """df with filtered: value of each recording through an IIR filter from rest, in the order given.

    Tasks filter many recordings, or chunks, side by side.  Equal to the recurrence over the whole recording but for rounding; where
    rows are missing, it goes on with the next one.  Rows of equal order go by value.  A null or NaN value makes the rest of its recording NaN, as the recurrence does.
    width is that of a chunk in units of the order column (microseconds of times); by default what scan.width_of finds.  A row's
    number in its recording, from 1, is beside it as place.  Rows without an order are a recording's last.
    """
    width = width or scan.width_of(df, key, order)
    # a struct is never null, so keys of null find their states too
    rows = scan.dealt(df, order, width, nulls_last=True).withColumn("_key", F.struct(key)).repartition("_key", scan.CHUNK)
    columns, inner = df.columns, [key, scan.CHUNK, F.asc_nulls_last(order), F.asc_nulls_last(value)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, end = None, None, None  # of a chunk that may go on
        for table, edges, on in scan.keys_in_parts(batches, [key, scan.CHUNK]):
            if held is not None and not on:
                yield from held.to_batches()
            n = np.diff(edges) + (n if on else 0)
            end = iir_series(b, a, scan.doubles(table.column(value)), edges, end if on else None, back=True)[1]
            out = table.select([key, scan.CHUNK]).take(edges[:-1]).append_column("n", pa.array(n, pa.int64()))
            held = out.append_column("end", scan.arrays(end)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = None, None
        for table, edges, on in scan.keys_in_parts(batches, [key, scan.CHUNK]):
            if not on:
                state, before = None, np.zeros(len(edges) - 1, dtype=np.int64)
                if "start" in table.column_names:
                    firsts = table.select(["start", "before"]).take(edges[:-1])
                    state, before = scan.matrix(firsts.column("start"), len(a) - 1), firsts.column("before").to_numpy()
            out, state = iir_series(b, a, scan.doubles(table.column(value)), edges, state)
            place = np.arange(1, len(out) + 1) + np.repeat(before - edges[:-1], np.diff(edges))
            before = place[-1:]
            # NaN becomes null, as in frames
            table = table.select(columns).append_column("filtered", pa.array(out, from_pandas=True)).append_column("place", pa.array(place))
            yield from table.combine_chunks().to_batches()

    given = rows
    if width < scan.ALL:
        # both passes over the rows read one exchange
        ends = rows.sortWithinPartitions(*inner).mapInArrow(summed, f"{scan.kinds(rows, key, scan.CHUNK)}, n long, end array<double>")
        begin = starts(ends, key, scan.CHUNK, step_matrix(b, a))
        given = rows.join(begin.select(F.struct(key).alias("_key"), scan.CHUNK, "start", "before"), ["_key", scan.CHUNK])
    return given.sortWithinPartitions(*inner).mapInArrow(run, f"{scan.kinds(df, *df.columns)}, filtered double, place long")


def gravity(signals: np.ndarray, rate: int, keep: float = 0.9) -> np.ndarray:
    """The means of exponential moving averages of (epoch, sample, axis), without their first second."""
    b, a = np.array([1 - keep, 0.0]), np.array([1.0, -keep])
    epochs, n, axes = signals.shape
    smooth = iir_many(b, a, signals.transpose(0, 2, 1).reshape(-1, n))[0].reshape(epochs, axes, n)
    return smooth[:, :, max(rate - 1, 0) :].mean(axis=2)


def powers(v: np.ndarray) -> np.ndarray:
    """Squared FFT magnitudes over n squared, of each row's Hann-windowed signal without its mean; the Nyquist bin is left out."""
    n = v.shape[1]
    return np.abs(np.fft.rfft((v - v.mean(axis=1, keepdims=True)) * np.hanning(n), axis=1)[:, : -(-n // 2)]) ** 2 / float(n) ** 2


def correlation(x: np.ndarray, y: np.ndarray, lag: int = 0) -> np.ndarray:
    """Correlation of each row of x with that of y lag samples later; 0 where it is not finite."""
    a, b = (x[:, : max(x.shape[1] - lag, 0)], y[:, lag:]) if lag else (x, y)
    if a.shape[1] < 1:
        return np.zeros(len(x))
    da, db = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        r = (da * db).mean(axis=1) / np.sqrt((da**2).mean(axis=1)) / np.sqrt((db**2).mean(axis=1))
    return np.where(np.isfinite(r), r, 0.0)


def rolling_median(x: np.ndarray, k: int) -> np.ndarray:
    """The medians of all full windows of k samples within each row."""
    return pd.Series(x.reshape(-1)).rolling(k).median().to_numpy().reshape(x.shape)[:, k - 1 :]


def arm_angles(xyz: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean five-second arm angle of each epoch, and mean absolute change between five-second means."""
    n, k, zero = xyz.shape[1], 5 * rate, np.zeros(len(xyz))
    if n // rate < 5:
        return zero, zero
    x, y, z = (rolling_median(xyz[:, :, c], k) for c in range(3))
    with np.errstate(all="ignore"):
        angle = np.degrees(np.arctan(z / (x**2 + y**2)))
    blocks = np.stack([angle[:, s : s + k].mean(axis=1) for s in range(0, angle.shape[1], k)], axis=1)
    change = np.abs(np.diff(blocks, axis=1)).mean(axis=1) if n // rate >= 10 and blocks.shape[1] > 1 else zero
    return blocks.mean(axis=1), change


def basic_statistics_many(xyz: np.ndarray, enmo: np.ndarray) -> dict[str, np.ndarray]:
    n, mean = xyz.shape[1], xyz.mean(axis=1)
    d = xyz - mean[:, None]
    cov = lambda i, j: (d[:, :, i] * d[:, :, j]).sum(axis=1) / (n + 1)  # noqa: E731  the divisor that models were trained with
    values = [np.maximum(enmo, 0).mean(axis=1), np.abs(enmo).mean(axis=1), *mean.T, *np.ptp(xyz, axis=1).T, *xyz.std(axis=1).T, cov(0, 1), cov(0, 2), cov(1, 2)]
    return dict(zip(BASIC, values, strict=True))


def basic_statistics(xyz: np.ndarray, enmo: np.ndarray) -> dict[str, float]:
    return {k: float(v[0]) for k, v in basic_statistics_many(xyz[None], enmo[None]).items()}


def _peak(p: np.ndarray, f: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and power of each row's first largest positive bin; -1 and 0 without one."""
    if not p.shape[1]:
        return np.full(len(p), -1.0), np.zeros(len(p))
    q = np.where(inside, p, 0.0)
    k = q.argmax(axis=1)
    top = q[np.arange(len(q)), k]
    return np.where(top > 0, f[k], -1.0), np.where(top > 0, top, 0.0)


def features_many(xyz: np.ndarray, enmo_trunc: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """The model features of resampled epochs (epoch, sample, axis), all of one length."""
    n = xyz.shape[1]
    g = gravity(xyz, rate)
    w = xyz - g[:, None]
    v = np.sqrt((w**2).sum(axis=2))
    mean, sd = v.mean(axis=1), v.std(axis=1, ddof=1)
    q = np.quantile(v, [0.5, 0, 1, 0.25, 0.75], axis=1)
    angles = [np.arctan2(w[:, :, a], w[:, :, b]) for a, b in ((1, 2), (2, 0), (1, 0))]
    out = [mean, sd, np.divide(sd, mean, out=np.zeros(len(v)), where=mean != 0), *q, correlation(v, v, rate), *(correlation(w[:, :, i], w[:, :, j]) for i, j in ((0, 1), (0, 2), (1, 2)))]
    out += [a.mean(axis=1) for a in angles] + [a.std(axis=1, ddof=1) for a in angles] + [np.arctan2(g[:, a], g[:, b]) for a, b in ((1, 2), (2, 0), (1, 0))]

    p, f = powers(v), np.arange(-(-n // 2)) * rate / n
    share = p / (p.sum(axis=1, keepdims=True) + EPS)
    positive = np.where(share > 0, share, 0.0)
    entropy = -(positive * np.log(positive + EPS)).sum(axis=1) / np.log(p.shape[1])
    top, band = _peak(p, f, np.ones(p.shape[1], bool)), _peak(p, f, (f > 0.3) & (f < 3))
    out += [top[0], np.log(top[1] + EPS), band[0], np.log(band[1] + EPS), entropy]
    hop = rate // 2
    welch = np.lib.stride_tricks.sliding_window_view(v, rate, axis=1)[:, ::hop][:, : n // hop - 1]
    size = np.abs(np.fft.rfft(welch * np.hanning(rate), axis=2))[:, :, :10].mean(axis=1) / rate
    out += list(np.log(np.pad(size, ((0, 0), (0, 10 - size.shape[1]))) + EPS).T)

    m = np.sqrt((xyz**2).sum(axis=2)) - 1
    d = m - m.mean(axis=1, keepdims=True)
    unit = d / (m.std(axis=1, keepdims=True) + EPS)
    N = float(n)
    out += [np.abs(d).mean(axis=1), (np.abs(d) ** 1.5).sum(axis=1) / N**1.5, (unit**3).sum(axis=1) * N / ((N - 1) * (N - 2))]
    out.append((unit**4).sum(axis=1) * N * (N + 1) / ((N - 1) * (N - 2) * (N - 3) * (N - 4)) - 3 * (N - 1) ** 2 / ((N - 2) * (N - 3)))
    out += arm_angles(xyz, rate)

    p = powers(enmo_trunc)
    inside = (f >= 0.3) & (f <= 15)
    left = np.array(inside & np.ones(p.shape, bool))
    for _ in range(2):
        one = _peak(p, f, left)
        out += [one[0], np.log(one[1] + EPS)]
        left &= f != one[0][:, None]
    mid = _peak(p, f, inside & (f > 0.6) & (f < 2.5))
    out += [mid[0], np.log(mid[1] + EPS), np.log(p[:, inside].sum(axis=1) + EPS)]
    return dict(zip(FEATURES, out, strict=True))


def features(xyz: np.ndarray, enmo_trunc: np.ndarray, rate: int) -> dict[str, float]:
    """The model features of one resampled epoch."""
    return {k: float(v[0]) for k, v in features_many(xyz[None], enmo_trunc[None], rate).items()}


def calibrate_samples(samples: DataFrame, coefficients: DataFrame | None, key: str, limit: float, keep: list[str] | None = None) -> DataFrame:
    """x, y, z calibrated and clamped, with boolean clip_before and clip_after.

    coefficients has one row per recording, as calibrate() returns; recordings without one stay as they are.  Columns to keep stay beside them.
    """
    axes = ("x", "y", "z")
    if coefficients is None:
        fixed = tuple(F.col(a) for a in axes)
        joined = samples
    else:
        # a row of scalars per recording: Spark broadcasts the table when it is small enough
        joined = samples.join(coefficients, key, "left")
        own = lambda a, p, default: F.coalesce(F.col(f"{a}_{p}"), F.lit(default))
        fixed = tuple(calibrated(F.col(a), F.coalesce("temp", F.lit(0.0)), own(a, "offset", 0.0), own(a, "slope", 1.0), own(a, "temp_slope", 0.0)) for a in axes)
    before, after = clip_flags(tuple(F.col(a) for a in axes), fixed, limit)
    out = {a: clamped(F.col(a), v, before, limit) for a, v in zip(axes, fixed, strict=True)}
    return joined.select(key, "t", *(v.alias(a) for a, v in out.items()), "temp", before.alias("clip_before"), after.alias("clip_after"), *(keep or []))


def epoch_features(samples: DataFrame, key: str, period: int = 30, rate: int = 100, with_features: bool = True, low_pass: float | None = 20.0, least: int = 10, resample: str = "linear", arrival: str | None = None) -> DataFrame:
    """One row per closed epoch of samples (key, t, x, y, z, temp, clip_before, clip_after): its statistics.

    Samples near an epoch's edges go to the next epoch too (and to the one before), as neighbours for interpolation.  The
    low-pass filter runs from epoch to epoch of a recording, over those with more than `least` samples; others leave its state as it is.

    dataErrors counts samples stuck at one value, one for a gap of two periods or more after the epoch, and, where arrival
    names the column that samples came in order of, one for each sample that came after a later one of its recording: it is left out, and
    counted in the epoch that was open when it came.
    """
    step = period * 1_000_000
    late = None
    if arrival:
        seen = latest_before(samples, key, "t", arrival)
        samples = seen.where("_seen IS NULL OR t >= _seen")
        late = seen.where("t < _seen").select(F.col(key).alias("_late"), "_seen").groupBy("_late", "_seen").agg(F.count("*").alias("n"))
        samples = samples.drop("_seen")
    cut = anchored(samples, key, "t", period).withColumn("_u", micros("t") - micros("epoch_start"))
    edge = int(1e6 * EDGE_SAMPLES / rate)
    near = F.array_compact(F.array(
        F.struct(F.col("epoch").alias("e"), F.col("_u").alias("u"), F.lit(True).alias("own")),
        F.when(F.col("_u") >= step - edge, F.struct((F.col("epoch") + 1).alias("e"), (F.col("_u") - step).alias("u"), F.lit(False).alias("own"))),
        F.when(F.col("_u") < 1e6, F.struct((F.col("epoch") - 1).alias("e"), (F.col("_u") + step).alias("u"), F.lit(False).alias("own"))),
    ))
    rows = cut.select(key, "epoch_start", "epoch", "_u", F.explode(near).alias("n"), "x", "y", "z", "temp", "clip_before", "clip_after")
    start = F.timestamp_micros(micros("epoch_start") + (F.col("n.e") - F.col("epoch")) * step).cast(samples.schema["t"].dataType)
    rows = rows.select(key, F.col("n.e").alias("epoch"), start.alias("time"), F.col("n.u").alias("u"), F.col("n.own").alias("own"), "x", "y", "z", "temp", "clip_before", "clip_after")
    names = [*BASIC, *(FEATURES if with_features else ()), *TAIL]
    count = period * rate
    b, a = butterworth(4, low_pass, rate) if low_pass and rate > 2 * low_pass else (None, None)
    at = np.round(np.arange(count) * 1000 / rate) * 1000.0

    def resampled(table: pa.Table, edges: np.ndarray) -> np.ndarray:
        """(epoch, sample, axis) of whole epochs, which lie one after the other on one axis."""
        first, last = edges[:-1], edges[1:] - 1
        apart = np.arange(len(first)) * float(step + edge + 2_000_000)
        u = scan.doubles(table.column("u")) + np.repeat(apart, np.diff(edges))
        points = at + apart[:, None]
        raw = [scan.doubles(table.column(c)) for c in "xyz"]
        if resample == "nearest":
            right = np.clip(np.searchsorted(u, points), first[:, None], last[:, None])
            left = np.maximum(right - 1, first[:, None])
            near = np.where(np.abs(points - u[left]) <= np.abs(u[right] - points), left, right)
            return np.stack([c[near] for c in raw], axis=2)
        before, after = points <= u[first][:, None], points >= u[last][:, None]
        between = [np.interp(points, u, c) for c in raw]
        return np.stack([np.where(after, c[last][:, None], np.where(before, c[first][:, None], v)) for c, v in zip(raw, between, strict=True)], axis=2)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables of some whole epochs with more than `least` samples, and where each begins."""
        for table, edges in scan.whole_keys(batches, [key, "epoch"]):
            own, size = table.column("own").to_numpy().astype(np.int64), np.diff(edges)
            live = np.add.reduceat(own, edges[:-1]) > least
            table, ends = table.filter(pa.array(np.repeat(live, size))).combine_chunks(), np.append(0, np.cumsum(size[live]))
            some = max(1, CELLS // count)
            for k in range(0, len(ends) - 1, some):
                inner = ends[k : k + some + 1]
                yield table.slice(inner[0], inner[-1] - inner[0]), inner - inner[0]

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in parts(batches):
            enmo = np.sqrt((resampled(table, edges) ** 2).sum(axis=2)) - 1
            out = table.select([key, "epoch"]).take(edges[:-1]).append_column("n", pa.array(np.full(len(enmo), count), pa.int64()))
            yield from out.append_column("end", scan.arrays(iir_many(b, a, enmo)[1])).combine_chunks().to_batches()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in parts(batches):
            xyz = resampled(table, edges)
            enmo = np.sqrt((xyz**2).sum(axis=2)) - 1
            firsts = table.take(edges[:-1])
            if b is not None:
                enmo = iir_many(b, a, enmo, scan.matrix(firsts.column("start"), len(a) - 1))[0]
            found = basic_statistics_many(xyz, enmo)
            if with_features:
                found |= features_many(xyz, np.maximum(enmo, 0), rate)
            epoch_of, own = np.repeat(np.arange(len(enmo)), np.diff(edges)), table.column("own").to_numpy()
            total = lambda v: np.bincount(epoch_of[own], np.asarray(v, dtype=float)[own], len(enmo))  # noqa: B023, E731
            temp = scan.doubles(table.column("temp"))
            known = ~np.isnan(temp)
            with np.errstate(all="ignore"):
                found["temp"] = total(np.where(known, temp, 0.0)) / total(known)
            stuck = ((xyz.std(axis=1) == 0) & (np.abs(xyz.mean(axis=1)) > 1.5)).sum(axis=1) * count
            found |= {"samples": np.full(len(enmo), count), "dataErrors": stuck + firsts.column("_errors").to_numpy()}
            found |= {f"clips{n}Calibr": total(table.column(c).to_numpy() == True) for n, c in (("Before", "clip_before"), ("After", "clip_after"))}  # noqa: E712  null is none
            found["rawSamples"] = total(own)
            out = firsts.select([key, "time"])
            for n in names:
                # NaN becomes null, as in frames
                out = out.append_column(n, pa.array(found[n].astype(np.int64)) if n in TAIL[1:] else pa.array(found[n], pa.float64(), from_pandas=True))
            yield from out.combine_chunks().to_batches()

    kinds = {n: "double" for n in names} | {n: "long" for n in TAIL[1:]}
    schema = f"{key} {samples.schema[key].dataType.simpleString()}, time {samples.schema['t'].dataType.simpleString()}, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    # a recording's last epoch is open: no later sample has closed it
    when = micros("epoch_start") + F.col("_u")
    spans = cut.groupBy(key, "epoch", F.col("epoch_start").alias("time")).agg(F.min(when).alias("_from"), F.max(when).alias("_to"))
    following = F.lead("_from").over(Window.partitionBy(key).orderBy("time"))
    spans = spans.withColumn("_gap", following - F.col("_to")).where("_gap IS NOT NULL")
    errors = (F.col("_gap") >= 2 * step).cast("long")
    if late is not None:
        # the epoch of the latest sample that had come: epochs are numbered from a recording's first
        firsts = cut.groupBy(F.col(key).alias("_key")).agg(F.min(micros("epoch_start")).alias("_zero"))
        begin = F.timestamp_micros(F.col("_zero") + F.expr(f"(unix_micros(cast(_seen as timestamp)) - _zero) div {step} * {step}")).cast(samples.schema["t"].dataType)
        opened = late.join(firsts, F.col("_late").eqNullSafe(F.col("_key"))).groupBy("_key", begin.alias("_time")).agg(F.sum("n").alias("_n_late"))
        spans = spans.join(opened, F.col(key).eqNullSafe(F.col("_key")) & (F.col("time") == F.col("_time")), "left").drop("_key", "_time")
        errors = errors + F.coalesce("_n_late", F.lit(0))
    closed = spans.select(key, "epoch", errors.alias("_errors"))
    # all passes over the samples read one exchange, by the columns that the join is by too; the scan between them has a row per epoch
    rows = rows.where(F.col(key).isNotNull() & F.col("epoch").isNotNull()).repartition(key, "epoch")
    inner = [key, "epoch", "u", "x", "y", "z"]
    if b is not None:
        ends = rows.sortWithinPartitions(*inner).mapInArrow(ends_of, f"{scan.kinds(rows, key, 'epoch')}, n long, end array<double>")
        closed = closed.join(starts(ends, key, "epoch", step_matrix(b, a)).drop("before"), [key, "epoch"])
    return rows.join(closed, [key, "epoch"]).sortWithinPartitions(*inner).mapInArrow(described, schema)
