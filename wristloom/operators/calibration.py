"""Auto-calibration: offsets, slopes and temperature slopes that put stationary points on the unit sphere.

A recording of up to GROUPED points is fitted by one task.  A larger one is fitted in rounds over all recordings of its
kind at once: a round is two aggregations of their points, a quantile sketch of the errors and the sums of the normal
equations, so no task holds a recording's points; recordings that have settled leave the rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

MIN_POINTS = 50
CUBE = 0.3  # g: some point must lie beyond each face of this cube
MAX_ROUNDS = 1000
IMPROVEMENT = 0.0001
MAX_ERROR = 0.01  # g
CUT = 0.995  # of the errors, beyond which a point has no weight
#: Points of a recording that one task fits, and the accuracy of a sketch of errors: ranks are off by the points over this.
GROUPED, SKETCH = 1 << 20, 10_000
AXES = ("x", "y", "z")
FIELDS = [*(f"{a}_{p}" for p in ("offset", "slope", "temp_slope") for a in AXES), "error_before", "error_after"]


def fit_sphere(points: np.ndarray, temp: np.ndarray) -> dict[str, float]:
    """Iterated weighted least squares of the points' projections on the unit sphere.

    Each round regresses, per axis, the projection on (1, value, temperature), with points weighted by how near they
    are, and composes the result with what was found before.  A pseudo-inverse takes constant temperatures.
    """
    points = points.astype(float)
    keep = np.linalg.norm(points, axis=1) > 1e-8 if len(points) else np.zeros(0, dtype=bool)
    points, temp = points[keep], temp[keep].astype(float)
    n = len(points)
    offset, slope, by_temp = np.zeros(3), np.ones(3), np.zeros(3)
    identity = (offset.copy(), slope.copy(), by_temp.copy())

    def error(p: np.ndarray) -> np.ndarray:
        return np.abs(np.linalg.norm(p, axis=1) - 1)

    before = float(error(points).mean()) if n else float("nan")
    best, best_error, good = identity, before, 0
    if n >= MIN_POINTS and (points.max(axis=0) >= CUBE).all() and (points.min(axis=0) <= -CUBE).all():
        now, least, settled = points, np.inf, False
        for _ in range(MAX_ROUNDS):
            e = error(now)
            top = np.quantile(e, CUT)
            weight = np.sqrt(np.maximum(1 - e / top, 0)) if top > 0 else np.ones(n)
            target = now / np.linalg.norm(now, axis=1, keepdims=True)
            for k in range(3):
                design = np.column_stack([np.ones(n), now[:, k], temp])
                a, b, c = np.linalg.pinv(design * weight[:, None]) @ (target[:, k] * weight)
                offset[k], slope[k], by_temp[k] = a + offset[k] * b, b * slope[k], c + by_temp[k] * b
            now = offset + points * slope + temp[:, None] * by_temp
            mean = float(error(now).mean())
            gain = (least - mean) / least if np.isfinite(least) else 1.0
            if mean < least:
                least, best = mean, (offset.copy(), slope.copy(), by_temp.copy())
            if gain < IMPROVEMENT:
                settled = True
                break
        good = int(settled and least <= MAX_ERROR)
        best_error = least if good else before
        best = best if good else identity
    values = [v for part in best for v in part]
    return dict(zip(FIELDS, [*values, before, best_error], strict=True)) | {"n_points": n, "good": good}


def stationary_points(epochs: DataFrame, tolerance: float = 0.013) -> DataFrame:
    """Epochs whose three deviations are all below the tolerance."""
    return epochs.where((F.col("xStd") < tolerance) & (F.col("yStd") < tolerance) & (F.col("zStd") < tolerance))


_COEFFICIENTS = [*(f"{a}_{p}" for p in ("offset", "slope", "temp_slope") for a in AXES)]


def _moved(points: DataFrame, state: DataFrame, key: str, *more: str) -> DataFrame:
    """points of the recordings in state, where their coefficients put them: _x, _y, _z, _length and _error."""
    given = state.select(F.col(key).alias("_key"), *_COEFFICIENTS, *more)
    rows = points.join(given, F.col(key).eqNullSafe(F.col("_key")))
    rows = rows.withColumns({f"_{a}": F.col(f"{a}_offset") + F.col(a) * F.col(f"{a}_slope") + F.col("temp") * F.col(f"{a}_temp_slope") for a in AXES})
    rows = rows.withColumn("_length", F.sqrt(sum(F.col(f"_{a}") ** 2 for a in AXES)))
    return rows.withColumn("_error", F.abs(F.col("_length") - 1))


def _cut_and_mean(rows: DataFrame, key: str) -> DataFrame:
    """(key, mean, top): the mean error, and its quantile CUT, between the two values that it lies between.

    A sketch says above which value they are; of the few errors above it (under a hundredth where there are many) the two are picked
    exactly, by their ranks.
    """
    found = rows.groupBy(key).agg(F.avg("_error").alias("mean"), F.count("*").alias("_n"), F.percentile_approx("_error", F.array(F.lit(0.97), F.lit(0.994)), F.lit(SKETCH)).alias("_q"))
    low = F.when(F.col("_n") > 5000, F.col("_q")[1]).otherwise(F.col("_q")[0])
    found = found.select(F.col(key).alias("_of"), "mean", "_n", low.alias("_low"))
    tail = rows.join(found, F.col(key).eqNullSafe(F.col("_of")))
    above = F.sort_array(F.collect_list(F.when(F.col("_error") >= F.col("_low"), F.col("_error"))))
    tail = tail.groupBy(key, "mean", "_n").agg(F.sum((F.col("_error") < F.col("_low")).cast("long")).alias("_below"), above.alias("_above"))
    at = (F.col("_n") - 1) * CUT
    value = lambda k: F.get("_above", (F.least(k, F.col("_n") - 1) - F.col("_below")).cast("int"))
    a, b = value(F.floor(at)), value(F.floor(at) + 1)
    return tail.select(key, "mean", (a + (b - a) * (at - F.floor(at))).alias("top"))


def _normal_sums(rows: DataFrame, key: str) -> DataFrame:
    """Per recording, the weighted sums that each axis' regression of its projection on (1, value, temperature) needs."""
    weight = F.when(F.col("top") > 0, F.greatest(1 - F.col("_error") / F.col("top"), F.lit(0.0))).otherwise(1.0)
    rows = rows.withColumn("_w", weight)
    w, t = F.col("_w"), F.col("temp")
    sums = {"w": w, "wt": w * t, "wtt": w * t * t}
    for a in AXES:
        v, y = F.col(f"_{a}"), F.col(f"_{a}") / F.col("_length")
        sums |= {f"{a}_v": w * v, f"{a}_vv": w * v * v, f"{a}_vt": w * v * t, f"{a}_y": w * y, f"{a}_vy": w * v * y, f"{a}_ty": w * t * y}
    return rows.groupBy(key).agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))


def _solved(state: DataFrame) -> DataFrame:
    """state with its coefficients composed with the solutions of the normal equations beside them."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)

    def task(parts):
        for pdf in parts:
            pdf = pdf.copy()
            s = lambda n, pdf=pdf: pdf[f"_s_{n}"].to_numpy(dtype=float)
            for a in AXES:
                left = np.array([[s("w"), s(f"{a}_v"), s("wt")], [s(f"{a}_v"), s(f"{a}_vv"), s(f"{a}_vt")], [s("wt"), s(f"{a}_vt"), s("wtt")]]).transpose(2, 0, 1)
                right = np.array([s(f"{a}_y"), s(f"{a}_vy"), s(f"{a}_ty")]).T
                p, q, r = (np.linalg.pinv(left, rcond=1e-12, hermitian=True) @ right[:, :, None])[:, :, 0].T if len(pdf) else np.zeros((3, 0))
                pdf[f"{a}_offset"] = p + pdf[f"{a}_offset"] * q
                pdf[f"{a}_slope"] = q * pdf[f"{a}_slope"]
                pdf[f"{a}_temp_slope"] = r + pdf[f"{a}_temp_slope"] * q
            yield pdf

    return state.mapInPandas(task, fields)


def fit_by_sums(points: DataFrame, key: str) -> DataFrame:
    """fit_sphere for every recording of points (key, x, y, z, temp), by aggregations only; errors are written to the shared folder each round."""
    points = written(points.where(F.sqrt(sum(F.col(a) ** 2 for a in AXES)) > 1e-8), "sphere-points")
    cover = F.count("*") >= MIN_POINTS
    for a in AXES:
        cover = cover & (F.max(a) >= CUBE) & (F.min(a) <= -CUBE)
    error = F.abs(F.sqrt(sum(F.col(a) ** 2 for a in AXES)) - 1)
    identity = {c: F.lit(1.0 if c.endswith("_slope") and "temp" not in c else 0.0) for c in _COEFFICIENTS}
    state = points.groupBy(key).agg(F.count("*").alias("n_points"), F.avg(error).alias("error_before"), cover.alias("live"))
    none = F.lit(None).cast("double")
    state = written(state.withColumns(identity | {f"best_{c}": v for c, v in identity.items()} | {"least": none, "settled": F.lit(False)}), "sphere-state")
    for turn in range(MAX_ROUNDS + 1):
        live = state.where("live")
        if live.isEmpty():
            break
        found = live.join(_cut_and_mean(_moved(points, live, key), key).withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
        if turn:
            # what the round before has come to
            better = F.col("least").isNull() | (F.col("mean") < F.col("least"))
            gain = F.coalesce((F.col("least") - F.col("mean")) / F.col("least"), F.lit(1.0))
            found = found.withColumns({"settled": gain < IMPROVEMENT, "_better": better})
            found = found.withColumns({f"best_{c}": F.when(F.col("_better"), F.col(c)).otherwise(F.col(f"best_{c}")) for c in _COEFFICIENTS})
            found = found.withColumn("least", F.when(F.col("_better"), F.col("mean")).otherwise(F.col("least"))).drop("_better")
            found = found.withColumn("live", ~F.col("settled") & F.lit(turn < MAX_ROUNDS))
        found = written(found.drop("mean"), "sphere-errors")
        on = found.where("live")
        sums = _normal_sums(_moved(points, on, key, "top"), key).withColumnRenamed(key, "_key")
        went = _solved(on.join(sums, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")).select(*state.columns)
        state = written(state.where("NOT live").union(found.where("NOT live").select(*state.columns)).union(went), "sphere-state")
    good = F.col("settled") & (F.coalesce("least", F.lit(np.inf)) <= MAX_ERROR)
    fixed = {c: F.when(good, F.col(f"best_{c}")).otherwise(v) for c, v in identity.items()}
    after = F.when(good, F.col("least")).otherwise(F.col("error_before")).alias("error_after")
    return state.select(key, *(v.alias(c) for c, v in fixed.items()), "error_before", after, "n_points", good.cast("int").alias("good"))


def calibrate(points: DataFrame, key: str, x: str = "xMean", y: str = "yMean", z: str = "zMean", temp: str | None = "temp", errors: str | None = "dataErrors", grouped: int = GROUPED) -> DataFrame:
    """One row per recording: offsets, slopes, temperature slopes (identity where the fit is not good) and errors.

    Rows with data errors or a null are left out, and a recording of none but such has no row.  Recordings of up to `grouped`
    points are fitted by a task each, larger ones by aggregations; both give the same coefficients to 1e-6.
    """
    rows = points.where(F.col(errors) == 0) if errors else points
    rows = rows.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"), (F.col(temp) if temp else F.lit(0.0)).cast("double").alias("temp")).dropna("any")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: pdf[key].iloc[0]} | fit_sphere(pdf[["x", "y", "z"]].to_numpy(), pdf["temp"].to_numpy())])

    fields = ", ".join(f"{f} double" for f in FIELDS)
    schema = f"{key} {points.schema[key].dataType.simpleString()}, {fields}, n_points long, good int"
    large = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > grouped).select(F.col(key).alias("_large")), "large-recordings")
    if large.isEmpty():
        return rows.groupBy(key).applyInPandas(one, schema)
    many = rows.join(large, F.col(key).eqNullSafe(F.col("_large")), "left_semi")
    few = rows.join(large, F.col(key).eqNullSafe(F.col("_large")), "left_anti")
    return few.groupBy(key).applyInPandas(one, schema).unionByName(fit_by_sums(many, key))
