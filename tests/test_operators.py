"""Operators with results that can be told beforehand."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wristloom.config import Config
from wristloom.errors import InvalidInput
from wristloom.functions import text as tx
from wristloom.operators import calibration, circadian, epochs as ep, forest, hmm, impute, labels, runs, signal, study
from wristloom.plans import recording

T0 = datetime(2020, 6, 15)


def epoch_rows(spark, values, step=30, key="p"):
    rows = [(key, T0 + timedelta(seconds=step * k), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, time timestamp_ntz, v double")


@pytest.mark.parametrize("n, bouts", [(121, 0), (122, 1)])
def test_nonwear_needs_more_than_the_patience(spark, n, bouts):
    df = epoch_rows(spark, [0.001] * n + [0.1])
    assert runs.nonwear_bouts(df, "id", "time", runs.stationary(["v"], 0.013), 60).count() == bouts


def test_null_deviation_is_never_still(spark):
    df = epoch_rows(spark, [None, 0.001, 0.013])
    assert [r[0] for r in df.orderBy("time").select(runs.stationary(["v"], 0.013)).collect()] == [False, True, False]


def test_regrid_marks_gaps(spark):
    df = epoch_rows(spark, [1.0, None, 3.0]).where("v IS NULL OR v > 0")
    extra = spark.createDataFrame([("p", T0 + timedelta(seconds=150), 9.0)], df.schema)
    got = ep.regrid(df.union(extra), "id", "time", 30).orderBy("time").collect()
    assert [r["missing"] for r in got] == [False, True, False, True, True, False]
    gap = ep.interrupts(df.union(extra), "id", "time", 30).first()
    assert (gap["interrupts_num"], gap["interrupt_mins"]) == (1, 1.5)


def test_imputation_is_sequential_and_leaves_empty_minutes(spark):
    # four Mondays-to-Sundays at one hour a day; a minute without any value stays null
    rows = [("p", T0 + timedelta(days=d, hours=h), None if h == 1 or d == 0 else float(d)) for d in range(14) for h in (0, 1)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, v double")
    got = {r["time"]: r["v"] for r in impute.impute(df, "id", "time", ["v"]).collect()}
    assert got[T0] == 7.0  # the other Monday
    assert all(got[T0 + timedelta(days=d, hours=1)] is None for d in range(14))


def test_short_streaks(spark):
    def relabelled(n, least):
        rows = [("p", k, "sleep") for k in range(n)] + [("p", n, "walk")]
        df = spark.createDataFrame(rows, "id string, k int, label string")
        return runs.relabel_short_streaks(df, "id", "k", "label", "sleep", "sedentary", least).where("label = 'sleep'").count()

    assert relabelled(120, 120) == 120 and relabelled(120, 121) == 0


def test_cut_points(spark):
    df = spark.createDataFrame([(0.02,), (0.045,), (0.06,), (0.1,), (0.15,), (0.4,), (0.5,), (None,)], "e double")
    got = df.select("e", *(v.alias(k) for k, v in labels.cut_point_columns(F.col("e")).items())).toPandas()
    want = ["CpSB", "CpSB", "CpLPA", "CpLPA", "CpMPA", "CpMPA", "CpVPA"]
    assert got.iloc[:7][["CpSB", "CpLPA", "CpMPA", "CpVPA"]].idxmax(axis=1).tolist() == want
    assert got.iloc[7][["CpSB", "CpMVPA"]].isna().all()
    assert df.select(labels.cut_point_columns(F.col("e"), worn=F.lit(False))["CpSB"]).first()[0] == 0.0


def sphere(n, seed=42, noise=0.002):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True) + rng.normal(0, noise, (n, 3)), rng.uniform(20, 28, n)


def test_calibration_recovers_a_known_error(spark):
    p, temp = sphere(1000)
    offset, slope = np.array([0.012, -0.018, 0.015]), np.array([0.985, 1.022, 0.994])
    raw = (p - offset) / slope
    df = spark.createDataFrame(pd.DataFrame(raw, columns=["xMean", "yMean", "zMean"]).assign(id="p", temp=temp, dataErrors=0))
    got = calibration.calibrate(df, "id").first()
    # a temperature slope stands in for part of the offset: compare at the mean temperature
    found = [got[f"{a}_offset"] + got[f"{a}_temp_slope"] * temp.mean() for a in "xyz"]
    assert got["good"] == 1 and np.allclose(found, offset, atol=0.015) and got["error_after"] < 0.01
    assert np.allclose([got[f"{a}_slope"] for a in "xyz"], slope, atol=0.025)


@pytest.mark.parametrize("points", [sphere(10)[0], np.tile([[0, 0, 1.02]], (300, 1)), np.zeros((80, 3))])
def test_calibration_refuses_poor_points(points):
    got = calibration.fit_sphere(points, np.zeros(len(points)))
    assert got["good"] == 0 and got["x_slope"] == 1.0 and got["z_offset"] == 0.0


def test_sinusoid_has_its_frequency():
    t = np.arange(3000) / 100
    xyz = np.stack([np.sin(2 * np.pi * 2 * t) * 0.3, np.zeros(3000), np.ones(3000)], axis=1)
    v = 1 + 0.3 * np.sin(2 * np.pi * 2 * t)
    f = signal.features(xyz, np.maximum(v - 1, 0), 100)
    assert f["f1"] == pytest.approx(2.0) and f["f625"] == pytest.approx(2.0)
    assert len(f) == 49 and all(np.isfinite(list(f.values())))


def test_filters():
    b, a = signal.butterworth(4, 20, 100)
    at = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 100)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 100)))
    assert at(0) == pytest.approx(1) and at(20) == pytest.approx(2**-0.5) and at(45) < 0.01
    bb, ba = signal.band_butterworth(2, 0.5, 15, 100)
    gain = lambda f: abs(np.polyval(bb[::-1], np.exp(-2j * np.pi * f / 100)) / np.polyval(ba[::-1], np.exp(-2j * np.pi * f / 100)))
    assert gain(0.5) == pytest.approx(2**-0.5, rel=1e-3) and gain(15) == pytest.approx(2**-0.5, rel=1e-3) and gain(0.001) < 0.01
    x = np.random.default_rng(0).normal(size=200)
    whole, _ = signal.iir(b, a, x)
    one, z = signal.iir(b, a, x[:90])
    two, _ = signal.iir(b, a, x[90:], z)
    assert np.allclose(whole, np.concatenate([one, two]))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    h = hmm.Hmm(list("abc"), rng.dirichlet(np.ones(3)).tolist(), rng.dirichlet(np.ones(3), 3).tolist(), rng.dirichlet(np.ones(3), 3).tolist())
    obs = rng.integers(0, 3, 6)
    score = lambda path: np.log(h.prior[path[0]]) + sum(np.log(h.emission[s][o]) for s, o in zip(path, obs, strict=True)) + sum(np.log(h.transition[a][b]) for a, b in zip(path, path[1:], strict=False))
    best = max(np.ndindex(*[3] * 6), key=score)
    assert hmm.decode(obs, h).tolist() == list(best)
    zero = hmm.Hmm(list("ab"), [0.0, 0.0], [[0.0, 0.0]] * 2, [[0.0, 0.0]] * 2)
    assert len(hmm.decode(np.zeros(4, int), zero)) == 4 and len(hmm.decode(np.zeros(0, int), zero)) == 0


def test_hmm_fit(spark):
    rows = [("p", k, "ab"[k % 2], 0.9 if k % 2 == 0 else 0.2) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, k int, y string, pa double").withColumn("pb", 1 - F.col("pa"))
    h = hmm.fit(df, "id", "k", "y", {"a": "pa", "b": "pb"})
    assert np.allclose(h.emission, [[0.9, 0.1], [0.2, 0.8]]) and np.allclose(h.transition, [[0, 1], [1, 0]])


def test_forest(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), "ab"[k % 2], float(rng.normal(4 * (k % 2), 1)), float(rng.normal())) for k in range(300)] + [(999, "a", float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "k int, y string, f0 double, f1 double")
    got = forest.predict(forest.train(df, "y", ["f0", "f1"], trees=10, depth=4), df, ["f0", "f1"])
    assert got.where("y = prediction").count() > 280
    assert got.where("k = 999").first()["prediction"] is None
    train, test = forest.split_by_participant(df, "y", ["b"])
    assert train.count() == 151 and test.count() == 150


def test_dominant_frequency(spark):
    n = 20 * 48
    rows = [("p", T0 + timedelta(minutes=30 * k), float(np.cos(2 * np.pi * 1.03 * k / 48))) for k in range(n)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, v double")
    got = circadian.dominant_frequency(df, "id", "time", F.col("v"), 1800).first()["frequency"]
    assert got == pytest.approx(1.03, abs=0.005)
    assert circadian.brent(lambda x: (x - 1.7) ** 2, 0, 1, 3) == pytest.approx(1.7, abs=1e-6)


def test_text_functions(spark):
    df = spark.createDataFrame([("20h", 20.0), ("1200m", 20.0), ("0.5d", 12.0), ("20", 20.0), ("x", None), (None, None)], "t string, h double")
    for got, want in df.select(tx.duration_hours(F.col("t")), "h").collect():
        assert got == want or got == pytest.approx(want)
    one = spark.range(1)
    ticks = one.select(tx.ticks_millis(F.lit(635887368000000000))).first()[0]
    assert datetime.fromtimestamp(ticks / 1000, tz=None).year == 2016 and ticks == 1453140000000
    shift = one.select(tx.shifted_millis(F.lit(0), F.lit("08:00:00")), tx.shifted_millis(F.lit(0), F.lit("-01:30:00"))).first()
    assert tuple(shift) == (-8 * 3600_000, 90 * 60_000)
    path = one.select(tx.participant_id(F.lit("a/b.c/1234_5.cwa.gz"))).first()[0]
    assert path == "1234_5"


def test_repair_prefers_the_one_before(spark):
    rows = [("d", T0 + timedelta(days=k), g, float(k)) for k, g in enumerate([False, True, False, True, False])] + [("e", T0, False, 9.0)]
    df = spark.createDataFrame(rows, "dev string, t timestamp_ntz, good boolean, v double")
    got = {(r["dev"], r["t"]): r["borrowed"] for r in study.repaired(df, F.col("good"), "dev", "t", "v").collect()}
    assert got == {("d", T0): 1.0, ("d", T0 + timedelta(days=2)): 1.0, ("d", T0 + timedelta(days=4)): 3.0}


def test_study_files(spark):
    files = spark.createDataFrame([("a/x.cwa",), ("b/x.cwa",), ("it's.cwa",)], "f string")
    assert study.duplicate_names(files, "f").collect()[0]["n"] == 2
    line = study.commands(files.where("f LIKE 'it%'"), "f", "run", "/o").first()["command"]
    assert line == "run 'it'\"'\"'s.cwa' --outputFolder '/o/it's/'"
    s = spark.createDataFrame([("p/1.cwa", 0.1, 0.2, 0.3)], "`file-name` string, a double, b double, c double")
    cells = s.selectExpr("`file-name`", *(f"{c} as `calibration-{x}{p}`" for p in ("Offset(g)", "Slope", "SlopeTemp") for x, c in zip("xyz", "abc", strict=True)))
    assert study.calibration_cells(cells).first()["calSlope"] == "0.1 0.2 0.3"
    assert study.collated(s).first()["eid"] == "1"


def test_config():
    assert Config(sample_rate=30).low_pass is None
    assert Config(coefficients={}).calibrate is False
    for bad in ({"sample_rate": 20}, {"start": "2021", "end": "2020"}, {"resample": "x"}):
        with pytest.raises(InvalidInput):
            Config(**bad)


def test_whole_run(spark):
    rate, minutes = 25, 6
    n = rate * 60 * minutes
    rng = np.random.default_rng(1)
    rows = pd.concat([
        pd.DataFrame({"id": p, "t": pd.to_datetime(T0) + pd.to_timedelta(np.arange(n) * 1000 // rate, unit="ms"), "x": rng.normal(0, s, n), "y": rng.normal(0, s, n), "z": 1 + rng.normal(0, s, n), "temp": 25.0})
        for p, s in (("still", 0.001), ("busy", 0.3))
    ])
    samples = spark.createDataFrame(rows).withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = recording.process(samples, "id", Config(sample_rate=rate, nonwear_minutes=2, ecdf=True))
    epochs = out["epochs"].toPandas()
    assert len(epochs) == 2 * (2 * minutes - 1) and set(signal.BASIC) <= set(epochs.columns)
    assert out["calibration"].where("good = 1").count() == 0
    metrics = {(r["id"], r["metric"]): r["value"] for r in out["metrics"].collect()}
    assert metrics["busy", "acc-week-avg"] > 50 and metrics["still", "wearTime-overall(days)"] == 0
    assert metrics["busy", "errs-interrupts-num"] == 0 and metrics["busy", "acc-ecdf-2000mg"] == 1
    assert out["series"].count() == len(epochs)


def test_iir_by_blocks_is_the_recurrence():
    """Blocks and their rest, with the state before them, give what the sample-by-sample recurrence gives."""
    import numpy as np

    from wristloom.operators import signal

    r = np.random.default_rng(3)
    b, a = signal.butterworth(4, 20.0, 100.0)
    b, a = b / a[0], a / a[0]
    for n in (0, 1, 63, 64, 65, 1000):
        x, z = r.normal(size=n), r.normal(size=len(a) - 1)
        got, want = signal.iir(b, a, x, z), signal._steps(b, a, x, z)
        assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[1], want[1], atol=1e-12)


def test_samples_of_a_recording_are_not_gathered(spark):
    """Epochs of one recording are anchored without a window over its samples."""
    from pyspark.sql import functions as F

    from wristloom.operators import epochs

    n = 200_000
    df = spark.range(n).select(F.lit("r").alias("key"), F.timestamp_micros(1_600_000_000_000_000 + F.col("id") * 10_000).cast("timestamp_ntz").alias("t"), F.col("id").alias("v"))
    cut = epochs.anchored(df, "key", "t", 30.0)
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()
    got = cut.groupBy("epoch").agg(F.count("*").alias("n"), F.min("v").alias("low")).orderBy("epoch").collect()
    assert [(r["n"], r["low"]) for r in got] == [(min(3000, n - 3000 * k), 3000 * k) for k in range(-(-n // 3000))]
