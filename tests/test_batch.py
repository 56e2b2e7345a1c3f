"""Runs over folders of recordings: failures as rows, whole summaries, the command line."""

import gzip
import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_sources import cwa_page
from wristloom import __main__ as command_line
from wristloom.config import Config
from wristloom.errors import InvalidInput
from wristloom.operators import forest, labels
from wristloom.plans import activity, batch, recording

START = datetime(2020, 6, 14, 10)
OPTIONS = {"sample_rate": 100, "epoch_period": 10, "calibrate": False, "features": False}


def recording_file(seed, seconds=48):
    rng = np.random.default_rng(seed)
    pages = []
    for k in range(seconds * 100 // 120):
        values = rng.integers(-200, 200, (120, 3))
        pages.append(cwa_page(START + timedelta(seconds=k * 1.2 // 1), [tuple(map(int, v)) for v in values], int((k * 1.2 % 1) * -100)))
    return b"".join(pages)


def test_one_broken_file_among_ten(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(9):
        (folder / f"r{k}.cwa").write_bytes(recording_file(k))
    (folder / "broken.cwa.gz").write_bytes(gzip.compress(recording_file(99))[:-50])
    run = batch.process_files(spark, str(folder), Config(**OPTIONS))
    status = {r["path"].rsplit("/", 1)[-1]: r for r in run.status.collect()}
    assert len(status) == 10 and [n for n, r in status.items() if not r["ok"]] == ["broken.cwa.gz"]
    assert status["broken.cwa.gz"]["message"] and status["r1.cwa"]["message"] is None
    assert run.results["epochs"].select("path").distinct().count() == 9
    short = batch.short_summary(run.results["metrics"])
    assert short.count() == 9 and set(batch.SHORT) <= set(short.columns)
    assert batch.report(run).first()["failed"] == 1
    # the same by the command line: exit code 1, outputs of the nine
    arguments = ["process", str(folder), "--out", str(tmp_path / "out"), "--sample-rate", "100", "--epoch-period", "10", "--no-calibrate", "--no-features"]
    assert command_line.main(arguments, spark) == 1
    assert "10 recordings, 1 failed" in capsys.readouterr().out
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "summary")).collect()]
    assert len(lines) == 9 and all(x["totalReads"] > 3000 and "day0-recorded-wearTime(hrs)" in x for x in lines)
    assert command_line.main(["collate", str(tmp_path / "out" / "summary"), "--out", str(tmp_path / "all")], spark) == 0
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == 9
    assert command_line.main(["commands", str(folder), "--out", str(tmp_path / "cmds")], spark) == 0
    found = [r["value"] for r in spark.read.text(str(tmp_path / "cmds")).collect()]
    assert len(found) == 10 and all(x.startswith("python -m wristloom process '") for x in found)


def test_nothing_to_read_and_contradictions(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.gt3x").write_bytes(b"none")
    run = batch.process_files(spark, str(tmp_path / "in"), Config(**OPTIONS))
    assert run.results is None and [r["ok"] for r in run.status.collect()] == [False]
    assert command_line.main(["process", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--resample", "cubic"], spark) == 2
    assert "InvalidInput" in capsys.readouterr().err
    with pytest.raises(InvalidInput):
        Config(start="2020-01-02", end="2020-01-01")


def two_weeks(spark, names):
    """Epochs of two recordings over a change of clocks, with features f0 and f1 that tell sleep from walking."""
    rng, frames = np.random.default_rng(0), []
    for name in names:
        t = pd.date_range("2020-03-26", periods=5 * 24 * 120, freq="30s")
        asleep = (t.hour < 8)
        busy = np.where(asleep, 0.0, 1.0)
        frames.append(pd.DataFrame({
            "id": name, "time": t, "enmoTrunc": 0.2 * busy + 0.001, "xStd": 0.1 + 0 * busy, "yStd": 0.1, "zStd": 0.1, "f0": busy * 3 + rng.normal(0, 0.5, len(t)), "f1": rng.normal(size=len(t)),
            "rawSamples": 3000, "clipsBeforeCalibr": 1, "clipsAfterCalibr": 2, "dataErrors": 0,
        }))
    out = pd.concat(frames)
    out.loc[(out["id"] == "b") & (out["time"] >= "2020-03-30"), "xStd"] = None  # the last day is missing
    schema = "id string, time timestamp_ntz, enmoTrunc double, xStd double, yStd double, zStd double, f0 double, f1 double, rawSamples long, clipsBeforeCalibr long, clipsAfterCalibr long, dataErrors long"
    df = spark.createDataFrame(out[[c.split()[0] for c in schema.split(", ")]], schema)
    return df.withColumn("xStd", F.when(~F.isnan("xStd"), F.col("xStd")))


def test_whole_summary_with_a_model(spark):
    epochs = two_weeks(spark, "ab")
    label = F.when(F.hour("time") < 8, "sleep").otherwise("walk")
    taught = epochs.where("id = 'a'").withColumns({"label": label, "participant": F.col("id"), "met": F.when(label == "sleep", 1.0).otherwise(3.5)})
    model, _ = activity.train(taught.where("minute(time) % 10 = 0"), ["f0", "f1"], met="met", folds=3, trees=10, depth=3)
    config = Config(epoch_period=30, zone="Europe/London", circadian=True, min_wear_hours=12, ecdf=True)
    given = spark.createDataFrame([("a", 0.01, 1.0, 0.0, 0.03, 0.005, 700, 1)], "id string, x_offset double, x_slope double, x_temp_slope double, error_before double, error_after double, n_points long, good int")
    series, metrics = recording.summarise_epochs(epochs, "id", config, model, given)
    found = {(r["id"], r["metric"]): r["value"] for r in metrics.collect()}
    a = {m: v for (i, m), v in found.items() if i == "a"}
    assert a["quality-daylightSavingsCrossover"] == 1 and a["totalReads"] == 3000 * 5 * 24 * 120 and a["firstDay(0=mon,6=sun)"] == 3
    assert a["clipsBeforeCalibration"] == 14_400 and a["clipsAfterCalibration"] == 28_800 and a["errs-data"] == 0
    assert a["fourier-frequency"] == pytest.approx(1, abs=0.02) and a["PSD"] > 0.1 and a["M10L5"] > 0.9
    assert a["day1-recorded-sleep(hrs)"] == pytest.approx(8, abs=0.2) and a["day1-recorded-wearTime(hrs)"] == 24 and a["day1-includedInSummary"] == 1
    assert a["sleep-hourOfDay-3-avg"] > 0.95 and a["walk-hourOfDay-15-avg"] > 0.95 and a["MET-week-avg"] == pytest.approx((8 * 1 + 16 * 3.5) / 24, abs=0.05)
    assert a["calibration-xOffset(g)"] == 0.01 and a["calibration-errsBefore(mg)"] == 30 and a["calibration-numStaticPoints"] == 700
    assert a["wearTime-numNonWearEpisodes(>1hr)"] == 0 and a["acc-ecdf-2000mg"] == 1 and a["CpMPA-overall-avg"] > 0.5
    assert found["b", "wearTime-numDaysExcluded"] == 1 and found["b", "day4-includedInSummary"] == 0
    assert {"sleep", "walk", "MET", "acc"} <= set(series.columns)


def test_no_training_row_is_lost_where_a_fold_lacks_a_label(spark):
    rows = [("p", f"t{k:03}", "rare" if k == 7 else "ab"[k % 2], float(k % 2), float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "participant string, time string, label string, f0 double, f1 double")
    folds = forest.stratified_folds(df, "label", 5, "participant", "time")
    sizes = folds.groupBy("label", "fold").count().toPandas().pivot(index="label", columns="fold", values="count").fillna(0)
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and sizes.to_numpy().sum() == 60
    crossed = forest.cross_predict(folds, "label", ["f0", "f1"], F.col("fold"), 5, trees=3, depth=3)
    assert crossed.count() == 60
    got = {r["label"]: r for r in crossed.collect()}
    # labels are a, b, rare: the fold that holds the only rare one has never seen it
    assert len(got["rare"]["probabilities"]) == 3 and got["rare"]["probabilities"][2] == 0
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in crossed.collect())
    model, _ = activity.train(df, ["f0", "f1"], folds=5, trees=5, depth=3)
    assert model.labels == ["a", "b", "rare"] and np.allclose(np.sum(model.hmm.emission, axis=1), 1)


def test_leave_one_participant_out(spark):
    rows = [(p, "ab"[k % 2], float(k % 2) + (0 if p != "z" else 5), float(k)) for p in ("x", "y", "z", None) for k in range(30)]
    df = spark.createDataFrame(rows, "who string, label string, f0 double, f1 double")
    got = forest.leave_one_out(df, "label", ["f0", "f1"], "who", trees=5, depth=3)
    assert got.count() == 90 and {(r["who"], r["fold"]) for r in got.select("who", "fold").distinct().collect()} == {("x", 0), ("y", 1), ("z", 2)}
    scores = {r["fold"]: r["macro_f1"] for r in labels.fold_scores(got, "fold", "label", "prediction").collect()}
    assert scores[0] == 1 and scores[1] == 1 and scores[2] < 0.5  # the third is unlike the others
    one = labels.cross_validation(got, "fold", "label", "prediction").first()
    assert one["folds"] == 3 and one["cv_25th_score"] <= one["cv_75th_score"] == 1


def test_forest_weights_are_shares(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "y string")
    assert {(r["y"], r["weight"]) for r in forest.balanced(df, "y").distinct().collect()} == {("a", 10 / 30), ("b", 1.0)}


def test_trees_of_an_undersampled_forest_see_as_much_of_every_label(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "rare" if k < 120 else "often", float(rng.normal(3.0 if k < 120 else 0.0, 1)), float(rng.normal())) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, y string, f0 double, f1 double")
    shares = []
    for tree in range(4):
        own = {r["y"]: (r["n"], r["w"]) for r in forest.tree_weights(df, "y", tree, ["k"]).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
        assert 80 < own["rare"][1] < 165 and 80 < own["often"][1] < 165 and own["rare"][0] < 100  # drawn with repeats
        shares.append(own)
    assert len({str(s) for s in shares}) == 4  # each tree draws its own
    again = forest.tree_weights(df.repartition(7), "y", 0, ["k"]).groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert {r["y"]: r["w"] for r in again} == {y: w for y, (_, w) in shares[0].items()}
    model = forest.train_undersampled(df, "y", ["f0", "f1"], trees=9, depth=4, by=["k"])
    got = forest.predict_undersampled(model, df)
    both = got.select("k", "y", "prediction").join(forest.predict(forest.train(df, "y", ["f0", "f1"], trees=9, depth=4), df, ["f0", "f1"]).select("k", F.col("prediction").alias("weighted")), "k")
    right, agree, caught = both.agg(F.avg((F.col("y") == F.col("prediction")).cast("double")), F.avg((F.col("prediction") == F.col("weighted")).cast("double")), F.avg(F.when(F.col("y") == "rare", (F.col("prediction") == "rare").cast("double")))).first()
    assert right > 0.85 and agree > 0.9 and caught > 0.85
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in got.limit(50).collect())
    odd = forest.predict_undersampled(model, df.limit(1).withColumn("f0", F.lit(float("nan")))).first()
    assert odd["prediction"] is None and odd["probabilities"] is None


def test_csv_recordings_between_two_times(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name in ("a", "b"):
        lines = ["time,x,y,z"] + [f"{(START + timedelta(milliseconds=20 * k)).isoformat(sep=' ', timespec='milliseconds')}+0000 [UTC],{v[0]:.4f},{v[1]:.4f},{v[2]:.4f}" for k, v in enumerate(rng.normal(size=(4000, 3)))]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    config = Config(sample_rate=50, epoch_period=10, calibrate=False, features=False, start="2020-06-14 10:00:20", end="2020-06-14 10:01:00")
    run = batch.process_files(spark, str(tmp_path), config)
    assert [r["ok"] for r in run.status.collect()] == [True, True]
    times = sorted({r["time"] for r in run.results["epochs"].collect()})
    assert times == [START + timedelta(seconds=20 + 10 * k) for k in range(4)]
