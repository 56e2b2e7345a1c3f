"""Epochs on a lagging grid, late samples and gaps, against a loop over single samples; errors of a batch run."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wristloom.config import Config
from wristloom.operators import epochs, signal
from wristloom.plans import recording
from wristloom.streaming import epochs as streams
from wristloom.streaming import gaps

T0 = datetime(2021, 5, 4, 8)
SCHEMA = "id string, t timestamp_ntz, x double, y double, z double, temp double, clip_before boolean, clip_after boolean, arrival long"


def loop(times, rows, period, least, edges):
    """One sample after the other."""
    start = prev = last = None
    errors, held, out = 0, [], []
    for t, row in zip(times, rows, strict=True):
        if start is None:
            start = t
        if prev is not None and t < prev:
            errors += 1
            continue
        if prev is not None and t - prev >= 2 * period:
            errors += 1
            if len(held) > least:
                out.append((start, [u - start for u, _ in held], errors))
            held, errors = [], 0
            while start < t - period:
                start += period
        if t - start >= period and len(held) > least:
            if edges:
                held.append((t, row))
            out.append((start, [u - start for u, _ in held], errors))
            held, errors = [], 0
            start += period
            if edges:
                held.append((prev, last))
        held.append((t, row))
        prev, last = t, row
    return out


def irregular(rng, n, rate, period):
    """Steps around 1 / rate, with repeated times, steps back, and gaps of a half to four periods."""
    steps = rng.integers(0, 2_000_000 // rate, n)
    steps = np.where(rng.random(n) < 0.03, -steps * 3, steps)
    steps = np.where(rng.random(n) < 0.02, rng.integers(period // 2, 4 * period, n), steps)
    return 1_600_000_000_000_000 + np.cumsum(steps)


@pytest.mark.parametrize("edges", [True, False])
@pytest.mark.parametrize("seed", range(8))
def test_closed_epochs_are_those_of_the_loop(seed, edges):
    rng = np.random.default_rng(seed)
    period, least = 1_000_000, 3 + seed
    times = irregular(rng, 3000, 20, period)
    rows = rng.normal(size=(len(times), 6))
    want = loop(times.tolist(), rows, period, least, edges)
    state, got, at = gaps.OpenEpoch(), [], 0
    while at < len(times):  # in pieces of any size
        n = int(rng.integers(1, 400))
        got += [(s, t.tolist(), e) for s, t, _, e in gaps.closed(state, times[at : at + n], rows[at : at + n], period, least, edges)]
        at += n
    assert got == want and any(e > 1 for *_, e in want)


def test_stream_of_irregular_samples(spark, tmp_path):
    rng = np.random.default_rng(5)
    period, rate, least = 5, 25, 10
    frames = []
    for name in ("a", "b"):
        times = irregular(rng, 2500, rate, period * 1_000_000)
        values = rng.normal(size=(len(times), 3))
        frames.append(pd.DataFrame({"id": name, "t": times.astype("datetime64[us]"), "x": values[:, 0], "y": values[:, 1], "z": values[:, 2], "temp": 20.0, "clip_before": rng.random(len(times)) < 0.1, "clip_after": False, "arrival": np.arange(len(times))}))
    for k in range(4):  # a file per micro-batch
        part = pd.concat([f.iloc[k * 700 : (k + 1) * 700] for f in frames])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drained(gaps.gap_epochs(stream, "id", "arrival", period, rate, low_pass=5.0, least=least), "gap-epochs", rocksdb=True)
    got = {n: g.sort_values("time") for n, g in out.toPandas().groupby("id")}
    b, a = signal.butterworth(4, 5.0, rate)
    for f in frames:
        rows = f[["x", "y", "z", "temp"]].to_numpy()
        clip = dict(zip(f["t"].astype("int64"), f["clip_before"], strict=True))
        want = loop(f["t"].astype("int64").tolist(), rows, period * 1_000_000, least, True)
        own = got[f["id"].iloc[0]]
        assert own["time"].astype("datetime64[us]").astype("int64").tolist() == [s for s, *_ in want]
        assert own["dataErrors"].tolist() == [e for *_, e in want] and own["rawSamples"].tolist() == [len(t) for _, t, _ in want]
        assert own["clipsBeforeCalibr"].sum() > 0 and len(clip) > 0 and own["enmoAbs"].notna().all()
    assert b is not None and a is not None


def test_late_samples_and_gaps_are_counted_as_errors(spark):
    rate, period = 25, 10
    times = [k / rate for k in range(rate * period * 2)]
    rows = [(T0 + timedelta(seconds=t), k) for k, t in enumerate(times)]
    # three late ones in the second epoch, one of them before the recording's first sample; then a gap of three periods
    late = [(T0 + timedelta(seconds=s), 400.5 + k / 10) for k, s in enumerate((1.0, -5.0, 15.9))]
    tail = [(T0 + timedelta(seconds=50 + k / rate), 1000 + k) for k in range(rate * period + 1)]
    data = [("r", t, 0.1 * np.sin(i), 0.2, 1.0 + 0.01 * np.cos(i), 20.0, False, False, float(i)) for t, i in rows + late + tail]
    samples = spark.createDataFrame([(*r[:2], float(r[2]), *r[3:4], float(r[4]), *r[5:]) for r in data], SCHEMA.replace("arrival long", "arrival double"))
    got = signal.epoch_features(samples, "r" and "id", period, rate, with_features=False, arrival="arrival").orderBy("time").collect()
    assert [((r["time"] - T0).seconds, r["dataErrors"], r["rawSamples"]) for r in got] == [(0, 0, 250), (10, 4, 250), (50, 0, 250)]
    kept = epochs.in_order(samples, "id", "t", "arrival", width=50.0)
    assert kept.count() == len(data) - 3
    run = recording.process(samples.drop("clip_before", "clip_after"), "id", Config(sample_rate=rate, epoch_period=period, calibrate=False, features=False, arrival="arrival"))
    assert {r["metric"]: r["value"] for r in run["metrics"].collect()}["errs-data"] == 4


def test_first_samples_are_broadcast_if_few_and_joined_by_hour_if_many(spark):
    n = 50_000
    df = spark.range(n).select(F.concat(F.lit("r"), F.col("id") % 3).alias("key"), F.timestamp_micros(1_600_000_000_000_000 + F.col("id") * 1_000_000).cast("timestamp_ntz").alias("t"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = epochs.anchored(df, "key", "t", 30.0), epochs.anchored(df, "key", "t", 30.0, few=0)
        rows = lambda d: sorted(map(tuple, d.collect()))
        assert rows(few) == rows(many) and len(rows(few)) == n
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0]
    assert "hashpartitioning(coalesce(key" in plans[1] and "_hour" in plans[1].split("hashpartitioning")[1].split("]")[0]


def test_interpolation_in_chunks(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.choice(20_000, 300, replace=False))
    samples = [("a", T0 + timedelta(milliseconds=int(k)), float(v)) for k, v in zip(t, rng.normal(size=300), strict=True)]
    points = [("a", T0 + timedelta(milliseconds=int(k))) for k in rng.integers(-500, 20_500, 200)]
    s = spark.createDataFrame(samples, "id string, t timestamp_ntz, v double")
    p = spark.createDataFrame(points, "id string, t timestamp_ntz")
    for nearest in (False, True):
        whole, cut = (sorted(map(tuple, epochs.interpolate(s, p, "id", "t", "v", nearest, w).collect())) for w in (None, 700_000.0))
        assert cut == whole
    want = np.interp([(x - T0).total_seconds() * 1000 for _, x in points], t, [v for *_, v in samples])
    got = {r["t"]: r["v"] for r in epochs.interpolate(s, p, "id", "t", "v", width=700_000.0).collect()}
    assert np.allclose([got[x] for _, x in points], want)


def test_epochs_as_a_table_function(spark):
    from wristloom.functions import tables

    rng = np.random.default_rng(4)
    rows = [(i, T0 + timedelta(seconds=float(s)), float(v) if rng.random() > 0.1 else None) for i in ("a", "b", None) for s, v in zip(rng.uniform(0, 900, 200), rng.normal(size=200), strict=True)]
    rows.append(("a", None, 1.0))
    spark.createDataFrame(rows, "id string, t timestamp_ntz, v double").createOrReplaceTempView("udtf_samples")
    tables.register(spark)
    got = spark.sql("SELECT * FROM epochs(TABLE(udtf_samples), 'id', 't', 'v', 30.0, 2)").toPandas().sort_values(["id", "epoch"])
    want = epochs.epoch_statistics(spark.table("udtf_samples"), "id", "t", "v", 30.0, least=2).toPandas().sort_values(["id", "epoch"])
    assert len(got) == len(want) > 60 and list(got.columns) == list(want.columns)
    assert got[["id", "epoch", "epoch_start", "n"]].fillna("").values.tolist() == want[["id", "epoch", "epoch_start", "n"]].fillna("").values.tolist()
    numbers = ["mean", "low", "high", "range", "std", "std_r"]
    assert np.allclose(got[numbers].to_numpy(dtype=float), want[numbers].to_numpy(dtype=float), atol=1e-12)
    with pytest.raises(Exception, match="no column nothing"):
        spark.sql("SELECT * FROM epochs(TABLE(udtf_samples), 'id', 't', 'nothing', 30.0)").collect()


def test_large_recordings_are_calibrated_by_sums(spark):
    from wristloom.operators import calibration

    rng = np.random.default_rng(0)
    rows, fixed = [], {}
    for name, n, noise, warm in (("good", 3000, 0.002, 3.0), ("constant", 800, 0.003, 0.0), ("noisy", 500, 0.3, 2.0), ("few", 40, 0.001, 1.0), ("flat", 400, 0.001, 1.0)):
        u = rng.normal(size=(n, 3))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        if name == "flat":
            u[:, 2] = np.abs(u[:, 2])
        temp = 20 + warm * rng.normal(size=n)
        p = (u - np.array([0.012, -0.018, 0.015]) - 0.0005 * temp[:, None] * (warm > 0)) / np.array([0.985, 1.022, 0.994]) + rng.normal(0, noise, (n, 3))
        rows += [(name, *map(float, v), float(t), 0) for v, t in zip(p, temp, strict=True)]
        fixed[name] = calibration.fit_sphere(p, temp)
    df = spark.createDataFrame([*rows, ("good", None, 1.0, 1.0, 1.0, 0), ("good", 9.0, 9.0, 9.0, 9.0, 1)], "id string, xMean double, yMean double, zMean double, temp double, dataErrors long")
    got = {r["id"]: r.asDict() for r in calibration.calibrate(df, "id", grouped=100).collect()}
    assert set(got) == set(fixed) and [n for n, r in sorted(got.items()) if r["good"]] == ["constant", "good"]
    for name, want in fixed.items():
        for field, value in want.items():
            assert got[name][field] == pytest.approx(value, abs=1e-6), (name, field)
