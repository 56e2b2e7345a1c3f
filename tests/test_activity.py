from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wristloom.errors import ModelError
from wristloom.operators import plots
from wristloom.plans import activity

T0 = datetime(2020, 6, 15)


def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in "abc":
        for k in range(120):
            y = ("sleep", "walk")[k // 20 % 2]
            rows.append((p, T0 + timedelta(seconds=30 * k), y, f"{y}-{k % 2}", 1.0 + (y == "walk") * 2, float(rng.normal(3 * (y == "walk"), 0.8)), float(rng.normal())))
    return spark.createDataFrame(rows, "participant string, time timestamp_ntz, label string, annotation string, m double, f0 double, f1 double")


def test_train_save_load_classify(spark, tmp_path):
    df = table(spark)
    model, tested = activity.train(df, ["f0", "f1"], annotation="annotation", met="m", test=["c"], folds=3, trees=20, depth=4)
    assert tested.count() == 120 and tested.where("prediction = label").count() > 110
    assert model.mets == {"sleep": 1.0, "walk": 3.0} and np.allclose(np.sum(model.hmm.transition, axis=1), 1)
    activity.save(model, str(tmp_path / "m"), spark)
    again = activity.load(str(tmp_path / "m"), spark)
    gap = df.withColumn("f0", F.when(F.col("time") > T0, F.col("f0")))
    got = activity.classify(again, gap, "participant", "time", enmo="f1", sleep="sleep", sleep_rows=30)
    assert got.where("time = TIMESTAMP_NTZ '2020-06-15' AND prediction IS NULL AND walk IS NULL").count() == 3
    assert got.where("prediction = 'sleep'").count() == 0 and {"MET", "CpSB", "sleep", "walk"} <= set(got.columns)
    with pytest.raises(ModelError):
        activity.load(str(tmp_path / "none"), spark)


def test_panels(spark):
    rows = [("p", T0 + timedelta(seconds=30 * k), 100.0 * k if k != 2 else None, k == 2, 1.0) for k in range(6) if k != 4]
    got = plots.panels(spark.createDataFrame(rows, "id string, time timestamp_ntz, acc double, imputed boolean, walk double"), "id", "time", ["walk"], 30).orderBy("time").collect()
    assert [r["acc"] for r in got] == [0.0, 50.0, None, 300.0, 300.0, 400.0] and [r["walk"] for r in got] == [2000, 2000, 0, 2000, 2000, 2000]
