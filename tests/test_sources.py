"""Binary formats: files made here are read back sample by sample."""

import gzip
import struct
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wristloom.errors import UnsupportedFormat
from wristloom.sources import actigraph, axivity, files, geneactiv, tables


def packed(t):
    return (t.year - 2000) << 26 | t.month << 22 | t.day << 17 | t.hour << 12 | t.minute << 6 | t.second


def cwa_page(t, samples, offset=0, code=74, wide=False):
    page = bytearray(512)
    page[:2] = b"AX"
    struct.pack_into("<IHH", page, 14, packed(t), 0, 300)
    struct.pack_into("<BBhH", page, 24, code, 0x32 if wide else 0x30, offset, len(samples))
    for i, (x, y, z) in enumerate(samples):
        if wide:
            struct.pack_into("<3h", page, 30 + 6 * i, x, y, z)
        else:
            struct.pack_into("<I", page, 30 + 4 * i, (x & 1023) | (y & 1023) << 10 | (z & 1023) << 20)
    return bytes(page)


@pytest.mark.parametrize("wide, zipped", [(False, False), (True, False), (False, True)])
def test_axivity(spark, tmp_path, wide, zipped):
    axivity.register(spark)
    header = bytearray(512)
    header[:2] = b"MD"
    struct.pack_into("<H", header, 5, 4321)
    n = 80 if wide else 120
    start = datetime(2020, 6, 14, 10)
    rng = np.random.default_rng(3)
    values = rng.integers(-500, 500, (4, n, 3))
    # 100 Hz and pages of whole seconds' stamps: stamp of the sample at the page's offset
    pages = [cwa_page(start + timedelta(seconds=k * n // 100), [tuple(map(int, v)) for v in values[k]], (k * n // 100) * 100 - k * n, wide=wide) for k in range(4)]
    data = bytes(header) + b"".join(pages) + b"xx" * 256
    path = tmp_path / ("a.cwa.gz" if zipped else "a.cwa")
    path.write_bytes(gzip.compress(data) if zipped else data)
    found = spark.read.format("axivity").option("partitionBytes", 1024).load(str(path))
    assert found.where("kind = 'header'").first()["device_id"] == 4321
    got = axivity.samples(found).orderBy("t").toPandas()
    assert len(got) == 4 * n
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), values.reshape(-1, 3) / 256)
    steps = got["t"].diff().dropna().dt.total_seconds()
    assert abs(steps.mean() - 0.01) < 1e-3 and got["t"].iloc[0].to_pydatetime() == start
    assert abs(got["temp"].iloc[0] - (300 * 150 - 20500) / 1000) < 1e-9


def test_axivity_bad_page(spark, tmp_path):
    axivity.register(spark)
    page = bytearray(cwa_page(datetime(2020, 1, 1), [(1, 2, 3)]))
    struct.pack_into("<I", page, 14, 0)  # month zero
    (tmp_path / "b.cwa").write_bytes(bytes(page))
    assert [r["kind"] for r in spark.read.format("axivity").load(str(tmp_path)).collect()] == ["bad"]


def test_ten_bits():
    words = np.array([(1023 | 511 << 10 | 512 << 20 | 2 << 30)], dtype=np.uint32)
    assert axivity.unpack_10bit(words).tolist() == [[-4, 2044, -2048]]


def test_geneactiv(spark, tmp_path):
    geneactiv.register(spark)
    header = [f"line {k}" for k in range(59)]
    header[1] = "Device Unique Serial Code:012345"
    for k, (gain, offset) in enumerate(((25000, 100), (25500, -200), (24500, 300))):
        header[47 + 2 * k], header[48 + 2 * k] = f"x gain:{gain}", f"x offset:{offset}"
    raw = np.array([[1, -1, 2047], [-2000, 5, 100]])
    payload = "".join("".join(f"{int(v) & 0xFFF:03x}" for v in s) + "000" for s in raw)
    page = ["Recorded Data", "Serial", "Seq", "Page Time:2020-06-14 10:00:00:500", "x", "Temperature:21.5", "Battery", "Status", "Measurement Frequency:50", payload]
    (tmp_path / "a.bin").write_text("\n".join(header + page + page[:4]) + "\n", encoding="latin-1")
    pages = spark.read.format("geneactiv").load(str(tmp_path))
    assert pages.first()["serial"] == "012345"
    got = geneactiv.samples(pages).orderBy("t").toPandas()
    want = (raw * 100.0 - np.array([100, -200, 300])) / np.array([25000, 25500, 24500])
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), want)
    assert got["t"].iloc[0].to_pydatetime() == datetime(2020, 6, 14, 10, 0, 0, 500000)
    assert got["t"].diff().iloc[1].total_seconds() == 0.02 and got["temp"].iloc[0] == 21.5


def bits12(values):
    out, acc, n = bytearray(), 0, 0
    for v in values:
        acc, n = acc << 12 | (int(v) & 0xFFF), n + 12
        while n >= 8:
            n -= 8
            out.append(acc >> n & 255)
    if n:
        out.append(acc << 8 - n & 255)
    return bytes(out)


def packet(kind, date, body):
    head = struct.pack("<BBIH", 0x1E, kind, date, len(body))
    check = 0
    for b in head + body:
        check ^= b
    return head + body + bytes([~check & 255])


def gt3x(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("_", "."), data)


INFO = "Serial Number: MOS2A1\nSample Rate: 30\nStart Date: 635887368000000000\nAcceleration Scale: 256.0\nTimeZone: 01:00:00\n"


def test_actigraph_pairs(spark, tmp_path):
    actigraph.register(spark)
    v = np.random.default_rng(1).integers(-2000, 2000, (40, 3))
    gt3x(tmp_path / "a.gt3x", info_txt=INFO, lux_bin=b"", activity_bin=bits12(v[:, [1, 0, 2]].reshape(-1)))
    got = actigraph.samples(spark.read.format("actigraph").load(str(tmp_path))).orderBy("t").toPandas()
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), v / 256)
    assert got["t"].iloc[0].to_pydatetime() == datetime(2016, 1, 18, 17)


def test_actigraph_packets(spark, tmp_path):
    actigraph.register(spark)
    a, b = np.random.default_rng(2).integers(-2000, 2000, (2, 30, 3))
    half = struct.pack("<BBBBI", 0, 0, 55, 0, 8 << 24 | 0x400000)  # 0.5 * 2**8
    log = packet(21, 100, half) + packet(0, 1000, bits12(a[:, [1, 0, 2]].reshape(-1))) + packet(26, 1001, b.astype("<i2").tobytes())
    bad = bytearray(packet(26, 1002, b.astype("<i2").tobytes()))
    bad[-1] ^= 1
    gt3x(tmp_path / "b.gt3x", info_txt=INFO.replace("01:00:00", "00:00:00"), log_bin=log + bytes(bad))
    rows = spark.read.format("actigraph").load(str(tmp_path))
    got = actigraph.samples(rows).orderBy("t").toPandas()
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), np.concatenate([a, b]) / 128, atol=6e-4)
    assert got["t"].iloc[0].timestamp() == pytest.approx(1000 + 0.033, abs=1e-3)
    assert rows.where("error = 'checksum'").count() == 1
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("actigraph").option("mode", "FAILFAST").load(str(tmp_path)).collect()


def test_sensor_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,x,y,z\n2020-06-14 10:00:00.000+0100 [Europe/London],0.1,0.2,1.0\n2020-06-14 10:00:00.010+0100 [Europe/London],0.2,0.3,0.9\n")
    got = tables.sensor_csv(spark, str(tmp_path)).orderBy("t").collect()
    assert [r["x"] for r in got] == [0.1, 0.2] and got[0]["t"] == datetime(2020, 6, 14, 9) and got[0]["temp"] == 0.0
    timed = tables.sensor_csv(spark, str(tmp_path), columns=(-1, 1, 2, 3), rate=100.0, start="2020-01-01 00:00:00").orderBy("t").collect()
    assert timed[1]["t"] == datetime(2020, 1, 1, 0, 0, 0, 10000)


def test_sensor_csv_in_splits(spark, tmp_path):
    """Line numbers go on over the splits of a file, and start anew in each file."""
    for name, n in (("a.csv", 5000), ("b.csv", 3000)):
        (tmp_path / name).write_text("t,x,y,z\n# second line\n" + "".join(f"?,{k},0,1\n" for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = tables.sensor_csv(spark, str(tmp_path), start_row=2, columns=(-1, 1, 2, 3), rate=1.0, start="2020-01-01 00:00:00")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 8000 and all((r["t"] - datetime(2020, 1, 1)).total_seconds() == r["x"] for r in got)


def test_discover_and_formats(spark, tmp_path):
    for name in ("b.CWA.gz", "a.gt3x", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[-1] for r in files.discover(spark, str(tmp_path)).collect()] == ["a.gt3x", "b.CWA.gz"]
    assert files.format_of("/x/Y.CWA.GZ") == "axivity"
    with pytest.raises(UnsupportedFormat):
        files.format_of("a.txt")


def test_sinks(spark, tmp_path):
    t0 = datetime(2020, 6, 14, 10)
    df = spark.createDataFrame([("p", t0 + timedelta(seconds=k), float(k), 0.5, 1.0) for k in range(5)], "id string, t timestamp_ntz, x double, y double, z double")
    row = tables.write_npy(df, str(tmp_path / "npy"), "id").first()
    back = tables.read_npy(str(tmp_path / "npy" / row["file"]))
    assert row["n"] == 5 and back["x"].tolist() == [0, 1, 2, 3, 4] and back["time"][0] == 1592128800 * 10**9
    tables.write_time_series(df, str(tmp_path / "ts"), "t", "Europe/London")
    again = spark.read.csv(str(tmp_path / "ts"), header=True).orderBy("t").first()
    assert again["t"] == "2020-06-14 11:00:00.000+0100 [Europe/London]"
    long = spark.createDataFrame([("p", "b", 2.0), ("p", "a", 1.0)], "id string, metric string, value double")
    tables.write_summary_json(long, str(tmp_path / "json"), "id")
    assert spark.read.text(str(tmp_path / "json")).first()["value"] == '{"a":1.0,"b":2.0}'
    assert "".join(tables.html_table(long, "t")).count("<tr>") == 3
    tables.write_raw_csv(df, str(tmp_path / "raw"))
    assert spark.read.csv(str(tmp_path / "raw"), header=True).count() == 5


def test_summaries(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a-summary.json").write_text('{\n "file-name": "x/a.cwa",\n "m": 1}')
    (tmp_path / "d" / "b-Summary.json").write_text('{"file-name": "x/b.cwa", "k": 2}')
    got = tables.summaries(spark, str(tmp_path))
    assert got.count() == 2 and set(got.columns) == {"file-name", "m", "k"}
    assert got.where(F.col("k").isNull()).count() == 1
