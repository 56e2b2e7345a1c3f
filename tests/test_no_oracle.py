"""Queries that SQL cannot say, against plain versions over the collected rows."""

import numpy as np
import pytest

from tests.test_features import naive
from tests.test_gaps import loop
from wristloom.operators import calibration, signal
from wristloom.plans import epoch_queries, label_queries, signal_queries, stream_queries

SF = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").toPandas()


def test_sphere_calibration(spark):
    got = {r["label"]: r.asDict() for r in signal_queries.QUERIES["sphere_calibration"](spark, SF).collect()}
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    assert set(got) == set(e["label"])
    for label, part in e.groupby("label"):
        v = np.stack(part["embedding"])[:, :3].astype(float)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        want = calibration.fit_sphere((u - [0.012, -0.018, 0.015]) / [0.985, 1.022, 0.994], np.zeros(len(u)))
        for field, value in want.items():
            assert got[label][field] == pytest.approx(value, abs=1e-7), (label, field)


def test_dominant_frequency(spark):
    """No frequency near the best bin has more power than the one that is found, and no other bin does."""
    known = epoch_queries._known(spark, SF).select("user_id", "time", "acc").toPandas().sort_values(["user_id", "time"])
    got = {r["user_id"]: r["frequency"] for r in epoch_queries.QUERIES["dominant_frequency"](spark, SF).collect()}
    assert set(got) == set(known["user_id"])
    for user, part in known.groupby("user_id"):
        x, n = part["acc"].to_numpy(), len(part)
        power = lambda k, x=x, n=n: abs(sum(x * np.exp(-2j * np.pi * k * np.arange(n) / n)))
        best = max(range(1, n // 2 + 1), key=lambda k: round(power(k), 9))
        found = got[user] * n * epoch_queries.PERIOD / 86400
        assert abs(found - best) <= 1
        assert power(found) >= max(power(best + d) for d in np.linspace(-1, 1, 401)) * (1 - 1e-5)


def resampled(u, rows, count, rate):
    at = np.round(np.arange(count) * 1000 / rate) * 1000.0
    order = np.argsort(u, kind="stable")
    return np.stack([np.interp(at, u[order], rows[order][:, k]) for k in range(3)], axis=1)


def test_epoch_features(spark):
    """Epochs, edges, the filter from epoch to epoch, and the columns of two epochs whole."""
    period, rate, count, step = 120, 10, 1200, 120_000_000
    e = events(spark)
    got = signal_queries.QUERIES["epoch_features"](spark, SF).toPandas()
    b, a = signal.butterworth(4, 4.0, rate)
    seen = 0
    for user, part in e.groupby("user_id"):
        us = part["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        t = ((us - us.min()) / 8640).astype("int64")
        rows = np.stack([part["value"] / 250, part["event_id"] % 7 / 7.0, np.full(len(part), 0.1)], axis=1)
        own, state = got[got["user_id"] == user].sort_values("time"), np.zeros(4)
        edge = int(1e6 * signal.EDGE_SAMPLES / rate)
        found = iter(own.to_dict("records"))
        for k in range(int(t.max()) // step):
            inside = (t >= k * step) & (t < (k + 1) * step)
            if inside.sum() <= 10:
                continue
            near = (t >= k * step - edge) & (t < (k + 1) * step + 1e6)
            xyz = resampled((t[near] - k * step).astype(float), rows[near], count, rate)
            enmo, state = signal._steps(b, a, np.sqrt((xyz**2).sum(axis=1)) - 1, state)
            r = next(found)
            assert r["rawSamples"] == inside.sum() and r["enmoAbs"] == pytest.approx(np.abs(enmo).mean(), abs=1e-8)
            assert r["enmoTrunc"] == pytest.approx(np.maximum(enmo, 0).mean(), abs=1e-8) and r["xStd"] == pytest.approx(xyz[:, 0].std(), abs=1e-8)
            if seen < 2:
                want = naive(xyz, enmo.tolist(), rate)
                # windows of ten samples have no more than five bins
                wrong = {c: (r[c], v) for c, v in want.items() if c not in ("fft6", "fft7", "fft8", "fft9", "fft10") and r[c] != pytest.approx(v, rel=1e-6, abs=1e-7)}
                assert not wrong
            seen += 1
        assert next(found, None) is None
    assert seen > 20


def test_stream_gap_epochs(spark):
    got = stream_queries.QUERIES["stream_gap_epochs"](spark, SF).toPandas()
    e = events(spark).sort_values("event_id")
    late = 0
    for user, part in e.groupby("user_id"):
        us = (part["ts"].astype("datetime64[us]").astype("int64") / 144).astype("int64").tolist()
        want = loop(us, part[["value"]].to_numpy(), 120_000_000, 2, True)
        own = got[got["user_id"] == user].sort_values("time")
        assert own["time"].astype("datetime64[us]").astype("int64").tolist() == [s for s, *_ in want]
        assert own["dataErrors"].tolist() == [x for *_, x in want] and own["rawSamples"].tolist() == [len(x) for _, x, _ in want]
        late += sum(x for *_, x in want)
    assert late > 0 and len(got) > 20


def test_forests_use_all_components(spark):
    assert len(label_queries.COMPONENTS) == 64
    got = label_queries.QUERIES["rf_predict"](spark, SF).toPandas()
    assert (got["label"] == got["prediction"]).mean() > 0.5 and got["top_probability"].between(0, 1).all()
    crossed = label_queries.QUERIES["rf_cross_predict"](spark, SF).toPandas()
    assert sorted(crossed["vec_id"]) == sorted(got["vec_id"])
