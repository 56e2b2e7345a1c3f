"""Scans along recordings in chunks: filters, Viterbi paths, last values, against runs over whole recordings."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.duck import rows as normal_rows
from wristloom.operators import hmm, scan, signal
from wristloom.plans import signal_queries

T0 = datetime(2020, 3, 1)
B, A = signal.butterworth(4, 20.0, 100.0)


def exchanges(df):
    """The executed plan's text, after it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_in_chunks_is_the_recurrence(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, n in (("long", 5000), ("short", 3), ("gaps", 900)):
        at = np.cumsum(rng.integers(1, 40 if name == "gaps" else 2, n))
        rows += [(name, int(t) - 700, float(v)) for t, v in zip(at, rng.normal(size=n), strict=True)]
    rows += [(None, k, 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "id string, k long, v double")
    want = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values(["id", "k"])
    want["filtered"] = np.concatenate([signal._steps(B, A, g["v"].to_numpy(), np.zeros(4))[0] for _, g in want.groupby("id", dropna=False, sort=False)])
    for width in (64.0, 333.5, None):
        got = signal.filtered(df, "id", "k", "v", B, A, width).toPandas().sort_values(["id", "k"])
        assert np.abs(got["filtered"].to_numpy() - want["filtered"].to_numpy()).max() < 1e-9
    assert signal.filtered(df.limit(0), "id", "k", "v", B, A).count() == 0
    assert signal.filtered(df.limit(0), "id", "k", "v", B, A, 10.0).count() == 0


def test_two_million_samples_of_one_recording_over_many_tasks(spark):
    n, pi = 2_000_000, float(np.pi)
    # 100 Hz with an hour's gap in the middle
    t = F.timestamp_micros(F.col("id") * 10_000 + F.when(F.col("id") > n // 2, 3_600_000_000).otherwise(0)).cast("timestamp_ntz")
    df = spark.range(0, n, 1, 16).select(F.lit("a").alias("key"), t.alias("t"), (F.sin(F.col("id") * pi / 7) + F.pmod(F.col("id") * 7919, F.lit(13)) / 13).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = signal.filtered(df, "key", "t", "v", B, A).withColumn("part", F.spark_partition_id()).toPandas().sort_values("t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == n and out["part"].nunique() >= 8
    want = signal.iir(B, A, out["v"].to_numpy())[0]
    assert np.abs(out["filtered"].to_numpy() - want).max() < 1e-9
    head = signal._steps(B, A, out["v"].to_numpy()[:200_000], np.zeros(4))[0]
    assert np.abs(out["filtered"].to_numpy()[:200_000] - head).max() < 1e-9


def test_both_passes_read_one_exchange(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(100)], "id string, k long, v double")
    assert "ReusedExchange" in exchanges(signal.filtered(df, "id", "k", "v", B, A, 7.0))


@pytest.mark.parametrize("width", [None, 90.0])
def test_a_task_filters_many_recordings(spark, width):
    """Recordings of many lengths, some with a null or an infinite value, one of null, whole and in chunks; no group is a frame of its own."""
    rng = np.random.default_rng(4)
    rows = [(None if i == 7 else i, 3 * k, float(v)) for i in range(60) for k, v in enumerate(rng.normal(size=int(rng.integers(1, 260))))]
    rows = [(i, k, None if i in (3, 7) and k == 240 else float("inf") if i == 5 and k == 60 else v) for i, k, v in rows]
    df = spark.createDataFrame(rows, "id long, k long, v double").repartition(5)
    out = signal.filtered(df, "id", "k", "v", B, A, width)
    plan = exchanges(out)
    assert "InPandas" not in plan and plan.count("MapInArrow") >= 1
    got = {(r["id"], r["k"]): (r["filtered"], r["place"], r["v"]) for r in out.collect()}
    assert len(got) == len(rows)
    frame = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values(["id", "k"])
    with np.errstate(all="ignore"):
        for i, g in frame.groupby("id", dropna=False):
            name = None if np.isnan(i) else int(i)
            for place, (k, w) in enumerate(zip(g["k"], signal._steps(B, A, g["v"].to_numpy(dtype=float), np.zeros(4))[0], strict=True), 1):
                v, at, _ = got[(name, k)]
                assert at == place and (v is None if np.isnan(w) else v == pytest.approx(w, abs=1e-9)), (name, k)


def test_filters_with_a_null_value_are_their_sql(spark, tmp_path):
    """Rows before the null keep their values, as in the recurrence that the SQL is."""
    events = [(k, u, None if (u, k % 150) == (2, 100) else float(k * 37 % 101)) for u in range(4) for k in range(u * 150, u * 150 + 150)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("ewma_gravity", "butterworth_lowpass"):
        got, want = signal_queries.QUERIES[name](spark, str(tmp_path)).toArrow(), con.sql(signal_queries.SQL[name]).to_arrow_table()
        assert normal_rows(got) == normal_rows(want), name


@pytest.mark.parametrize("width", [None, 50.0])
def test_rows_without_an_order_are_last(spark, width):
    """In chunks as in one: as row_number() over the order column has them in the SQL."""
    rows = [(u, k, float(k * 37 % 101)) for u in range(3) for k in range(200 + u)] + [(1, None, 5.0), (1, None, 3.0), (None, None, 2.0)]
    got = signal.filtered(spark.createDataFrame(rows, "u long, k long, v double"), "u", "k", "v", B, A, width).where("k IS NULL").orderBy("u", "place").collect()
    want = signal._steps(B, A, np.array([float(k * 37 % 101) for k in range(201)] + [3.0, 5.0]), np.zeros(4))[0]
    assert [(r["u"], r["place"], r["v"]) for r in got] == [(None, 1, 2.0), (1, 202, 3.0), (1, 203, 5.0)]
    assert [r["filtered"] for r in got] == pytest.approx([B[0] * 2.0, *want[-2:]], abs=1e-9)


def test_long_keys_come_in_parts():
    """No table holds more than `rows` and two batches, keys up to `rows` come whole, and a row is given once, in order."""
    rng = np.random.default_rng(1)
    for case in range(40):
        lengths = rng.choice([1, 2, 7, 30, 31, 100, 450], size=int(rng.integers(1, 12)))
        keys = np.repeat(np.arange(len(lengths)), lengths)
        table = pa.table({"a": pa.array([None if k == 0 else int(k) // 2 for k in keys], pa.int64()), "b": (keys % 2).tolist(), "i": np.arange(len(keys))})
        batches = table.to_batches(max_chunksize=int(rng.integers(1, 40)))
        at, known = 0, set()
        for part, edges, on in scan.keys_in_parts(iter(batches), ["a", "b"], 30):
            own = keys[at : at + len(part)]
            assert part.column("i").to_pylist() == list(range(at, at + len(part))) and len(part) < 30 + 2 * 40, case
            assert edges.tolist() == [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)], case
            assert on == (int(own[0]) in known) and (not on or len(edges) == 2), case
            short = [k for k in set(own.tolist()) if lengths[k] < 30]
            assert all((own == k).sum() == lengths[k] for k in short), case
            at, known = at + len(part), known | set(own.tolist())
        assert at == len(keys), case
    assert not list(scan.keys_in_parts(iter([]), ["a"]))


def test_a_dense_chunk_is_filtered_in_parts(spark):
    """Recordings that lie in a short stretch of a long span: all of each is one chunk but for a last sample far away."""
    n = 250_000
    df = spark.range(0, n, 1, 4).select(F.col("id").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1009)) / 1009).alias("v"))
    df = df.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("u"), "k", (F.col("v") * F.col("u")).alias("v"))
    df = df.union(spark.createDataFrame([(u, 10**12, 1.0) for u in (1, 2, 3)], "u int, k long, v double"))
    out = signal.filtered(df, "u", "k", "v", B, A).toPandas().sort_values(["u", "k"])
    for u, g in out.groupby("u"):
        assert np.abs(g["filtered"].to_numpy() - signal.iir(B, A, g["v"].to_numpy())[0]).max() < 1e-9
        assert g["place"].tolist() == list(range(1, (n if u < 3 else 0) + 2))


def test_epochs_filter_on_from_epoch_to_epoch(spark):
    """enmoAbs of each epoch, with a gap and an epoch of too few samples, against one filter over all its epochs."""
    rate, period = 50, 10
    rng = np.random.default_rng(3)
    times = [k / rate for k in range(3 * period * rate)] + [5 * period + k / rate for k in range(5)] + [7 * period + k / rate for k in range(2 * period * rate + 1)]
    xyz = rng.normal(0, 1, (len(times), 3))
    rows = [("p", T0 + timedelta(seconds=t), *map(float, v), 20.0, False, False) for t, v in zip(times, xyz, strict=True)]
    samples = spark.createDataFrame(rows, "id string, t timestamp_ntz, x double, y double, z double, temp double, clip_before boolean, clip_after boolean")
    got = signal.epoch_features(samples, "id", period, rate, with_features=False, low_pass=5.0).orderBy("time").collect()
    assert [(r["time"] - T0).seconds for r in got] == [0, 10, 20, 70, 80]
    enmo, at = np.sqrt((xyz**2).sum(axis=1)) - 1, np.array(times)
    b, a = signal.butterworth(4, 5.0, rate)
    state = np.zeros(4)
    for r in got:
        inside = enmo[(at >= (r["time"] - T0).seconds - 1e-9) & (at < (r["time"] - T0).seconds + period - 1e-9)]
        out, state = signal._steps(b, a, inside, state)
        assert r["enmoAbs"] == pytest.approx(np.abs(out).mean(), abs=1e-12)


def model(states, seed, grid=None):
    rng = np.random.default_rng(seed)
    share = lambda *n: (lambda p: (p / p.sum(axis=-1, keepdims=True)).tolist())(rng.random(n) + 0.05)
    return hmm.Hmm([f"s{k}" for k in range(states)], share(states), share(states, states), share(states, states), grid)


@pytest.mark.parametrize(("width", "grid"), [(10.0, None), (37.0, None), (1.0, None), (13.0, 2.0**-20)])
def test_viterbi_in_chunks_is_the_path_of_whole_recordings(spark, width, grid):
    rng = np.random.default_rng(int(width))
    m = model(4, 7, grid)
    rows = [(name, k * step, m.labels[rng.integers(4)] if rng.random() > 0.1 else (None, "odd")[k % 2]) for name, n, step in (("a", 400, 1), ("b", 60, 9), ("c", 1, 1), (None, 30, 1)) for k in range(n)]
    rows += [("none", k, None) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, k long, label string")
    got = hmm.smooth(df, "id", "k", "label", m, width).toPandas().sort_values(["id", "k"])
    whole = hmm.smooth(df, "id", "k", "label", m).toPandas().sort_values(["id", "k"])
    assert got["smoothed"].tolist() == whole["smoothed"].tolist()
    at = {x: k for k, x in enumerate(m.labels)}
    for name in "ab":
        seen = [(k, x) for i, k, x in sorted(r for r in rows if r[0] == name) if x in at]
        path = [m.labels[s] for s in hmm.decode(np.array([at[x] for _, x in seen]), m)]
        assert got[(got["id"] == name) & got["smoothed"].notna()]["smoothed"].tolist() == path
    assert got[got["id"] == "none"]["smoothed"].isna().all() and got[~got["label"].isin(at)]["smoothed"].isna().all()


def test_equal_paths_take_the_first_state_however_cut(spark):
    """A symmetric model has ties at every change of label; on a grid of logarithms they are ties to the bit."""
    k = 5
    m = hmm.Hmm([f"s{i}" for i in range(k)], [1 / k] * k, [[0.6 if i == j else 0.1 for j in range(k)] for i in range(k)], [[0.52 if i == j else 0.12 for j in range(k)] for i in range(k)], 2.0**-24)
    rng = np.random.default_rng(9)
    rows = [("a", i, m.labels[s]) for i, s in enumerate(np.repeat(rng.integers(0, k, 120), rng.integers(1, 4, 120)).tolist())]
    df = spark.createDataFrame(rows, "id string, k long, label string")
    want = [m.labels[s] for s in hmm.decode(np.array([m.labels.index(x) for _, _, x in rows]), m)]
    for width in (4.0, 11.0, 50.0):
        assert [r["smoothed"] for r in hmm.smooth(df, "id", "k", "label", m, width).orderBy("k").collect()] == want


def test_transitions_of_one_series_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_ROWS", 8)
    monkeypatch.setattr(scan.width_of, "__defaults__", (8,))
    rng = np.random.default_rng(1)
    labels = [str(rng.integers(3)) if rng.random() > 0.1 else None for _ in range(100)]
    df = spark.createDataFrame([(k % 4, k, x) for k, x in enumerate(labels)], "id long, k long, label string")
    got = {(r["from"], r["to"]): r["n"] for r in hmm.transitions(df, None, "k", "label").collect()}
    want = pd.Series([p for p in zip(labels, labels[1:], strict=False) if None not in p]).value_counts().to_dict()
    assert got == want


def test_last_values_are_carried_over_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(k), float(k) if rng.random() < p else None) for i, p in (("a", 0.5), ("b", 0.01), ("c", 0.0)) for k in rng.permutation(300)[:200]]
    df = spark.createDataFrame(rows, "id string, k long, v double")
    frame = pd.DataFrame(rows, columns=["id", "k", "v"]).sort_values(["id", "k"])
    for ahead in (False, True):
        want = frame.groupby("id")["v"].transform(lambda v, ahead=ahead: v.bfill() if ahead else v.ffill())
        got = scan.carried(df, "id", "k", {"seen": F.col("v")}, 16.0, ahead).toPandas().sort_values(["id", "k"])
        assert got["seen"].fillna(-1).tolist() == want.fillna(-1).tolist()
