"""Slices of recordings read few pages; broken files are rows; sinks show whole writes only."""

import gzip
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, LessThanOrEqual, StringStartsWith

from tests.test_sources import INFO, bits12, cwa_page, gt3x, packet
from wristloom.sources import actigraph, axivity, geneactiv, npy, slices

START = datetime(2020, 6, 14)


def week(pages, every):
    header = bytearray(512)
    header[:2] = b"MD"
    return bytes(header) + b"".join(cwa_page(START + timedelta(seconds=every * k), [(1, 2, 3)] * 5) for k in range(pages))


def test_an_hour_of_a_week_reads_few_pages(spark, tmp_path, monkeypatch):
    n, every = 10_080, 60
    (tmp_path / "a.cwa").write_bytes(week(n, every))
    low, high = (axivity.micros(START + timedelta(hours=h)) for h in (80, 81))
    reads = []
    decode = axivity.decode_page
    monkeypatch.setattr(axivity, "decode_page", lambda *a: reads.append(a[1]) or decode(*a))
    for size in (64 << 20, 512 * 1000):
        reader = axivity.AxivityReader({"path": str(tmp_path / "a.cwa"), "partitionbytes": str(size)})
        given = [GreaterThan(("time_us",), low), LessThanOrEqual(("time_us",), high), StringStartsWith(("path",), "x")]
        assert list(reader.pushFilters(given)) == given
        reads.clear()
        got = [r[1] for p in reader.partitions() for r in reader.read(p) if r[2] == "data"]
        assert set(range(80 * 60 + 2, 81 * 60 + 2)) <= set(got) and len(reads) < 0.04 * n
        if size > 1 << 20:
            assert len(reads) < 0.02 * n
    axivity.register(spark)
    whole = spark.read.format("axivity").load(str(tmp_path))
    cut = axivity.between(whole, "2020-06-17 08:00:00", "2020-06-17 09:00:00")
    assert cut.count() == 63
    exact = lambda pages: axivity.samples(pages).where("t BETWEEN TIMESTAMP_NTZ '2020-06-17 08:00:00' AND TIMESTAMP_NTZ '2020-06-17 09:00:00'")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(exact(cut)) == rows(exact(whole)) and exact(cut).count() > 200


def test_pages_without_order_are_all_read(spark, tmp_path):
    times = [5, 1, 9, 3, 7]
    (tmp_path / "a.cwa").write_bytes(b"".join(cwa_page(START + timedelta(minutes=m), [(1, 2, 3)]) for m in times) + b"x" * 512)
    axivity.register(spark)
    at = axivity.micros(START + timedelta(minutes=4))
    got = spark.read.format("axivity").option("ordered", "false").load(str(tmp_path)).where(F.col("time_us") > at)
    assert sorted(r["page"] for r in got.collect()) == [0, 2, 4]


def test_range_of_filters():
    r = slices.TimeRange("t")
    r.push([GreaterThan(("t",), 3), LessThan(("t",), 9), GreaterThan(("u",), 100), EqualTo(("t",), 5)])
    assert (r.low, r.high) == (5, 5) and r.holds(5) and r.before(4) and r.after(6) and r.holds(None)
    assert [slices.first_place(0, 10, lambda k, n=n: k < n) for n in (0, 4, 10, 99)] == [0, 4, 10, 10]


def test_geneactiv_slice(spark, tmp_path, monkeypatch):
    header = [f"line {k}" for k in range(59)]
    for k in range(47, 53):
        header[k] = f"x:{100 * k}"
    pages = []
    for k in range(3000):
        t = (START + timedelta(minutes=k)).strftime("%Y-%m-%d %H:%M:%S:000")
        pages += ["Recorded Data", "Serial", f"Sequence Number:{k}", f"Page Time:{t}", "x", f"Temperature:{20 + k % 3}", "Battery", "Status", "Measurement Frequency:50", "00100200" + "3" * (4 + k % 7 * 12)]
    (tmp_path / "a.bin").write_text("\n".join(header + pages) + "\n", encoding="latin-1")
    seen = []
    real = geneactiv.page_time
    monkeypatch.setattr(geneactiv, "page_time", lambda line: seen.append(line) or real(line))
    reader = geneactiv.GeneactivReader({"path": str(tmp_path / "a.bin")})
    reader.pushFilters([GreaterThan(("time",), START + timedelta(minutes=2000)), LessThan(("time",), START + timedelta(minutes=2020))])
    got = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert set(range(2001, 2020)) <= set(got) and len(got) < 25 and len(seen) < 80
    monkeypatch.undo()
    geneactiv.register(spark)
    df = spark.read.format("geneactiv").load(str(tmp_path))
    assert df.count() == 3000 and df.where("time >= TIMESTAMP_NTZ '2020-06-15 00:00:00' AND time < TIMESTAMP_NTZ '2020-06-15 00:10:00'").count() == 10
    assert df.where("time > TIMESTAMP_NTZ '2030-01-01 00:00:00'").count() == 0


def test_actigraph_slice(spark, tmp_path):
    body = bits12([1, 2, 3] * 30)
    log = b"".join(packet(0, 1000 + k, body) for k in range(500))
    gt3x(tmp_path / "a.gt3x", info_txt=INFO.replace("01:00:00", "00:00:00"), log_bin=log)
    actigraph.register(spark)
    df = spark.read.format("actigraph").load(str(tmp_path))
    assert df.count() == 500
    assert sorted(r["packet"] for r in df.where("start_ms >= 1100000 AND start_ms < 1105000").collect()) == list(range(100, 105))
    reader = actigraph.ActigraphReader({"path": str(tmp_path / "a.gt3x")})
    reader.pushFilters([LessThan(("start_ms",), 1_010_000)])
    assert len([r for p in reader.partitions() for r in reader.read(p)]) <= 11


def test_broken_files_are_rows_and_others_go_on(spark, tmp_path):
    for module, name, good, broken in (
        (axivity, "axivity", week(3, 1), None),
        (actigraph, "actigraph", None, b"no zip"),
    ):
        module.register(spark)
        folder = tmp_path / name
        folder.mkdir()
        if name == "axivity":
            for k in range(3):
                (folder / f"{k}.cwa").write_bytes(good)
            (folder / "bad.cwa.gz").write_bytes(gzip.compress(good)[:-20])
            rows = spark.read.format(name).load(str(folder))
            assert rows.where("kind = 'data' AND path NOT LIKE '%bad%'").count() == 9
            # no page lies there; a reader that may stop before the broken end does not see it
            assert [r["kind"] for r in rows.where(F.col("time_us") > axivity.micros(START) + 10**12).collect()] == ["failed"]
            assert rows.where(F.col("time_us") < 5).count() == 0
        else:
            gt3x(folder / "a.gt3x", info_txt=INFO, lux_bin=b"", activity_bin=bits12([1, 2, 3] * 4))
            (folder / "bad.gt3x").write_bytes(broken)
            rows = spark.read.format(name).load(str(folder))
            assert actigraph.samples(rows).count() == 4
            with pytest.raises(Exception, match="zip"):
                spark.read.format(name).option("mode", "FAILFAST").load(str(folder)).collect()
        failed = rows.where(F.col("error").startswith("failed: ")).collect()
        assert len(failed) == 1 and "bad" in failed[0]["path"]
    geneactiv.register(spark)
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "bad.bin").write_text("\n".join(["x:notanumber"] * 70))
    assert spark.read.format("geneactiv").load(str(tmp_path / "g")).where("error LIKE 'failed: %'").count() == 1


def test_a_failed_task_leaves_no_visible_file(spark, tmp_path):
    rows = [(f"p{k}", START + timedelta(hours=h), float(k), 0.0, 1.0) for k in range(4) for h in (1, 30)]
    df = spark.createDataFrame(rows, "id string, t timestamp_ntz, x double, y double, z double")
    folder = tmp_path / "out"
    bad = df.withColumn("x", F.when(F.col("id") == "p3", F.raise_error(F.lit("broken sample"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken sample"):
        npy.write_npy(bad, str(folder), "id")
    assert not folder.exists() or not any(folder.iterdir())
    files = npy.write_npy(df, str(folder), "id")
    names = sorted(p.name for p in folder.iterdir())
    assert len(files.collect()) == 8 and names == sorted([*(r["file"] for r in files.collect()), "manifest.json"])
    again = npy.write_npy(df.where("id = 'p1'"), str(folder), "id")
    assert again.count() == 2 and len(list(folder.iterdir())) == 3
    assert npy.read_npy(str(folder / "p1-2020-06-15.npy.gz"))["x"].tolist() == [1.0]


def test_an_attempt_that_is_not_committed_goes(tmp_path):
    """Two attempts of a task have written; only one is committed."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["2020-01-01"]), pa.array([1]), *[pa.array([1.0])] * 3], ["key", "day", "us", "x", "y", "z"])
    writer = npy.NpyWriter({"path": str(tmp_path / "w")}, True)
    writer.write(iter([batch]))
    second = writer.write(iter([batch]))
    assert not (tmp_path / "w" / "a-2020-01-01.npy.gz").exists()
    writer.commit([second, None])
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["a-2020-01-01.npy.gz", "manifest.json"]
    writer = npy.NpyWriter({"path": str(tmp_path / "w")}, False)
    writer.write(iter([batch]))
    writer.abort([None])
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["a-2020-01-01.npy.gz", "manifest.json"]
    assert struct.calcsize("<q") == 8
