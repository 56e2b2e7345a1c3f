"""Every column of basic_statistics() and features() against loops over single samples."""

import cmath
import math

import numpy as np
import pytest

from wristloom.operators import signal


def mean(v):
    return sum(v) / len(v)


def population_sd(v):
    m = mean(v)
    return math.sqrt(sum((x - m) ** 2 for x in v) / len(v))


def sample_sd(v):
    m = mean(v)
    return math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1))


def quantile(v, q):
    s, at = sorted(v), q * (len(v) - 1)
    k = int(at)
    return s[k] if k + 1 == len(s) else s[k] + (s[k + 1] - s[k]) * (at - k)


def pearson(x, y, lag=0):
    a, b = x[: len(x) - lag], y[lag:]
    ma, mb = mean(a), mean(b)
    top = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True))
    bottom = math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    return top / bottom if bottom else 0.0


def hann(v):
    return [x * 0.5 * (1 - math.cos(2 * math.pi * i / (len(v) - 1))) for i, x in enumerate(v)]


def dft_power(v, bins):
    """Squared magnitudes over n squared."""
    n = len(v)
    return [abs(sum(x * cmath.exp(-2j * math.pi * k * i / n) for i, x in enumerate(v))) ** 2 / n**2 for k in range(bins)]


def naive(xyz, enmo, rate):
    x, y, z = ([float(r[k]) for r in xyz] for k in range(3))
    n = len(x)
    out = {"enmoTrunc": mean([max(e, 0) for e in enmo]), "enmoAbs": mean([abs(e) for e in enmo])}
    for name, v in zip("xyz", (x, y, z), strict=True):
        out |= {f"{name}Mean": mean(v), f"{name}Range": max(v) - min(v), f"{name}Std": population_sd(v)}
    for a, b, u, v in (("x", "y", x, y), ("x", "z", x, z), ("y", "z", y, z)):
        out[f"{a}{b}Cov"] = sum((p - mean(u)) * (q - mean(v)) for p, q in zip(u, v, strict=True)) / (n + 1)

    gravity = []
    for v in (x, y, z):
        smooth, after = 0.0, []
        for i, value in enumerate(v):
            smooth = 0.9 * smooth + 0.1 * value
            if i >= rate - 1:
                after.append(smooth)
        gravity.append(mean(after))
    wx, wy, wz = ([p - g for p in v] for v, g in zip((x, y, z), gravity, strict=True))
    vm = [math.sqrt(a * a + b * b + c * c) for a, b, c in zip(wx, wy, wz, strict=True)]
    sd = sample_sd(vm)
    out |= {"mean": mean(vm), "sd": sd, "coefvariation": sd / mean(vm), "median": quantile(vm, 0.5), "min": min(vm), "max": max(vm), "25thp": quantile(vm, 0.25), "75thp": quantile(vm, 0.75)}
    out |= {"autocorr": pearson(vm, vm, rate), "corrxy": pearson(wx, wy), "corrxz": pearson(wx, wz), "corryz": pearson(wy, wz)}
    for name, a, b, ga, gb in (("roll", wy, wz, 1, 2), ("pitch", wz, wx, 2, 0), ("yaw", wy, wx, 1, 0)):
        angles = [math.atan2(p, q) for p, q in zip(a, b, strict=True)]
        out |= {f"avg{name}": mean(angles), f"sd{name}": sample_sd(angles), f"{name}g": math.atan2(gravity[ga], gravity[gb])}

    bins = math.ceil(n / 2)
    p = dft_power(hann([v - mean(vm) for v in vm]), bins)
    freq = [rate / n * k for k in range(bins)]
    best, band = (-1, 0), (-1, 0)
    entropy = 0.0
    for f, q in zip(freq, p, strict=True):
        if q > best[1]:
            best = (f, q)
        if 0.3 < f < 3 and q > band[1]:
            band = (f, q)
        share = q / (sum(p) + 1e-8)
        if share > 0:
            entropy -= share * math.log(share + 1e-8)
    out |= {"fmax": best[0], "pmax": math.log(best[1] + 1e-8), "fmaxband": band[0], "pmaxband": math.log(band[1] + 1e-8), "entropy": entropy / math.log(bins)}
    windows = n // (rate // 2) - 1
    sums = [0.0] * 10
    for i in range(windows):
        part = dft_power(hann(vm[i * (rate // 2) : i * (rate // 2) + rate]), 10)
        sums = [s + math.sqrt(q) for s, q in zip(sums, part, strict=True)]
    out |= {f"fft{k + 1}": math.log(s / windows + 1e-8) for k, s in enumerate(sums)}

    m = [math.sqrt(a * a + b * b + c * c) - 1 for a, b, c in zip(x, y, z, strict=True)]
    d, s = [v - mean(m) for v in m], population_sd(m)
    N = float(n)
    out |= {"MAD": sum(map(abs, d)) / N, "MPD": sum(abs(v) ** 1.5 for v in d) / N**1.5, "skew": sum((v / (s + 1e-8)) ** 3 for v in d) * N / ((N - 1) * (N - 2))}
    out["kurt"] = sum((v / (s + 1e-8)) ** 4 for v in d) * N * (N + 1) / ((N - 1) * (N - 2) * (N - 3) * (N - 4)) - 3 * (N - 1) ** 2 / ((N - 2) * (N - 3))

    k = 5 * rate
    medians = [[quantile(v[i : i + k], 0.5) for i in range(n - k + 1)] for v in (x, y, z)]
    angle = [math.degrees(math.atan(c / (a * a + b * b))) for a, b, c in zip(*medians, strict=True)]
    blocks = [mean(angle[i : i + k]) for i in range(0, len(angle), k)]
    out |= {"avgArmAngel": mean(blocks), "avgArmAngelAbsDiff": mean([abs(b - a) for a, b in zip(blocks, blocks[1:], strict=False)]) if n // rate >= 10 else 0.0}

    trunc = [max(e, 0) for e in enmo]
    p = dft_power(hann([v - mean(trunc) for v in trunc]), bins)
    one, two, mid, total = (-1, 0), (-1, 0), (-1, 0), 0.0
    for f, q in zip(freq, p, strict=True):
        if f < 0.3 or f > 15:
            continue
        total += q
        if q > one[1]:
            one, two = (f, q), one
        elif q > two[1]:
            two = (f, q)
        if q > mid[1] and 0.6 < f < 2.5:
            mid = (f, q)
    for name, (f, q) in (("1", one), ("2", two), ("625", mid)):
        out |= {f"f{name}": f, f"p{name}": math.log(q + 1e-8)}
    return out | {"totalPower": math.log(total + 1e-8)}


@pytest.mark.parametrize(("seed", "rate", "n"), [(0, 30, 330), (1, 30, 271), (2, 40, 200), (3, 50, 550)])
def test_all_columns(seed, rate, n):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / rate
    xyz = np.stack([0.3 * np.sin(2 * np.pi * 1.7 * t), 0.2 * np.cos(2 * np.pi * 0.9 * t), 1 + 0.1 * np.sin(2 * np.pi * 4.1 * t)], axis=1) + rng.normal(0, 0.05, (n, 3))
    enmo = np.sqrt((xyz**2).sum(axis=1)) - 1
    got = signal.basic_statistics(xyz, enmo) | signal.features(xyz, np.maximum(enmo, 0), rate)
    want = naive(xyz, enmo.tolist(), rate)
    assert set(got) == set(want) == {*signal.BASIC, *signal.FEATURES}
    wrong = {k: (got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], rel=1e-9, abs=1e-9)}
    assert not wrong


def test_epochs_side_by_side_are_each_alone():
    """One of them flat, one stuck, one with a NaN."""
    rng = np.random.default_rng(5)
    xyz = rng.normal(0, 0.4, (5, 300, 3))
    xyz[1] = 0.25
    xyz[2, :, 1] = 1.75
    xyz[3, 17, 0] = np.nan
    enmo = np.sqrt((xyz**2).sum(axis=2)) - 1
    got = signal.basic_statistics_many(xyz, enmo) | signal.features_many(xyz, np.maximum(enmo, 0), 30)
    for k in range(5):
        one = signal.basic_statistics(xyz[k], enmo[k]) | signal.features(xyz[k], np.maximum(enmo[k], 0), 30)
        for name, v in one.items():
            assert got[name][k] == pytest.approx(v, rel=1e-9, abs=1e-12, nan_ok=True), (k, name)
    assert np.isnan(got["mean"][3]) and np.isfinite(got["mean"][[0, 1, 2, 4]]).all()


@pytest.mark.parametrize("n", [1, 63, 64, 200])
def test_series_side_by_side_are_the_recurrence(n):
    b, a = signal.butterworth(4, 20.0, 100.0)
    rng = np.random.default_rng(n)
    x, z = rng.normal(size=(6, n)), rng.normal(size=(6, 4))
    x[2, n // 2] = np.nan
    out, state = signal.iir_many(b, a, x, z)
    for k in range(6):
        want, end = signal._steps(b, a, x[k], z[k])
        assert np.allclose(out[k], want, rtol=0, atol=1e-12, equal_nan=True) and np.allclose(state[k], end, rtol=0, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("resample", ["linear", "nearest"])
def test_a_task_takes_many_epochs(spark, monkeypatch, resample):
    """Ragged epochs, a NaN, gaps and a key of null, some at a time, against one epoch at a time; no group is a frame of its own."""
    from datetime import datetime, timedelta

    from tests.test_scan import exchanges

    rng = np.random.default_rng(11)
    rows = []
    for user in ("a", "b", None, "c"):
        at = np.cumsum(rng.exponential(0.25, 400)) + (40 if user == "b" else 0)
        at[200:] += 33
        rows += [(user, datetime(2020, 1, 1) + timedelta(seconds=round(float(t), 6)), *map(float, rng.normal(size=3)), None if k % 5 else 20.0, k % 3 == 0, None) for k, t in enumerate(at)]
    rows[30] = (*rows[30][:2], float("nan"), *rows[30][3:])
    df = spark.createDataFrame(rows, "id string, t timestamp_ntz, x double, y double, z double, temp double, clip_before boolean, clip_after boolean")
    run = lambda: signal.epoch_features(df, "id", 10, 10, low_pass=2.0, least=3, resample=resample)
    plan = exchanges(run())
    assert "MapInArrow" in plan and "ReusedExchange" in plan and "InPandas" not in plan
    got = run().toPandas().sort_values(["id", "time"])
    monkeypatch.setattr(signal, "CELLS", 1)
    want = run().toPandas().sort_values(["id", "time"])
    assert len(got) > 20 and set(got["id"]) == {"a", "b", "c"}
    for c in got.columns[2:]:
        assert np.allclose(got[c].to_numpy(), want[c].to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True), c
    first = min(r[1] for r in rows if r[0] == "c")
    for r in got[got["id"] == "c"].itertuples():
        inside = [q for q in rows if q[0] == "c" and 0 <= (q[1] - first).total_seconds() - (r.time - first).total_seconds() < 10]
        assert r.rawSamples == len(inside) and r.clipsBeforeCalibr == sum(q[6] for q in inside) and r.clipsAfterCalibr == 0
