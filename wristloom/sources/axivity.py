"""Axivity .cwa recordings: 512-byte pages, decoded in parallel by page range.

The source returns one row per data page with its samples as arrays.  A page's sample times depend on the page before
it, which is a lag over the pages of a file: `samples` computes them and explodes the arrays.

Filters on time_us are pushed into the source: stamps rise through a file, so a range's pages are found by binary search, and
no others are read (option ordered=false reads all).  A file that cannot be read gives a row of kind `failed`, and the others go on.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import FAILED, blocks, file_system, listed
from .slices import TimeRange, allow_pushdown, first_place

PAGE = 512
SCHEMA = "path string, page long, kind string, time_us long, time_index int, n int, rate double, temp double, x array<double>, y array<double>, z array<double>, device_id long, error string"
EPOCH = datetime(1970, 1, 1)


def packed_time(value: int) -> datetime:
    """Six fields of 6, 4, 5, 5, 6 and 6 bits: years from 2000, month, day, hour, minute, second."""
    return datetime(2000 + (value >> 26 & 63), value >> 22 & 15, value >> 17 & 31, value >> 12 & 31, value >> 6 & 63, value & 63)


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def unpack_10bit(words: np.ndarray) -> np.ndarray:
    """n x 3 axes of 32-bit words: three signed 10-bit numbers and a 2-bit exponent."""
    exponent = (words >> 30).astype(np.int64)
    out = []
    for shift in (0, 10, 20):
        v = (words >> shift & 0x3FF).astype(np.int64)
        out.append((v - ((v & 0x200) << 1)) << exponent)
    return np.stack(out, axis=1)


def decode_page(path: str, number: int, page: bytes) -> tuple | None:
    """A row of SCHEMA for a header or data page; None for any other."""
    mark = page[:2]
    empty: list[float] = []
    if mark == b"MD":
        (device,) = struct.unpack_from("<H", page, 5)
        (start,) = struct.unpack_from("<I", page, 13)
        try:
            at = micros(packed_time(start))
        except ValueError:  # no delayed start
            at = None
        return path, number, "header", at, None, 0, None, None, empty, empty, empty, device, None
    if mark != b"AX":
        return None
    try:
        old_device, = struct.unpack_from("<H", page, 4)
        stamp, _, temp = struct.unpack_from("<IHH", page, 14)
        code, layout, offset, count = struct.unpack_from("<BBhH", page, 24)
        rate, fraction = float(offset), 0
        if code:
            rate = 3200.0 / (1 << (15 - (code & 15)))
            if old_device & 0x8000:
                fraction = (old_device & 0x7FFF) << 1
                offset += fraction * int(rate) >> 16
        else:
            offset = 0
        rate = rate if rate > 0 else 1.0
        wide = 6 if layout & 15 == 2 else 4
        count = min(count, 480 // wide)
        at = micros(packed_time(stamp)) + round(fraction / 65536 * 1e6)
        if wide == 6:
            xyz = np.frombuffer(page, "<i2", 3 * count, 30).reshape(-1, 3)
        else:
            xyz = unpack_10bit(np.frombuffer(page, "<u4", count, 30))
        x, y, z = (xyz / 256.0).T.tolist() if count else (empty, empty, empty)
        return path, number, "data", at, offset, count, rate, (temp * 150.0 - 20500) / 1000, x, y, z, None, None
    except (ValueError, struct.error) as e:
        return path, number, "bad", None, None, 0, None, None, empty, empty, empty, None, str(e)


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class AxivityReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", 64 << 20)) // PAGE * PAGE
        self.ordered = options.get("ordered", "true").lower() != "false"
        self.range = TimeRange("time_us")

    def pushFilters(self, filters):
        return self.range.push(filters)

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path, (".cwa", ".cwa.gz")):
            if path.lower().endswith(".gz"):
                out.append(Range(path, 0, -1))  # a gzip stream has one reader
            else:
                out += [Range(path, at, min(size, at + self.bytes)) for at in range(0, size, self.bytes)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        try:
            if part.stop >= 0 and self.ordered:
                part = self._in_range(part)
            for k, page in enumerate(self._pages(part)):
                row = decode_page(part.path, part.start // PAGE + k, page)
                if row is None:
                    continue
                if self.ordered and row[2] == "data" and self.range.after(row[3]):
                    return
                yield row
        except Exception as e:
            # stamped within a pushed range, so that its filters keep the row
            yield part.path, None, "failed", self.range.inside(1), None, 0, None, None, [], [], [], None, f"{FAILED}{e}"

    def _in_range(self, part: Range) -> Range:
        """The pages of part from the first that is not before the range to the last that is not after it."""
        if self.range.low is None and self.range.high is None:
            return part
        files, name = file_system(part.path)
        with files.open_input_file(name) as f:

            def time_of(k: int) -> int | None:
                """The stamp of the first data page from k on."""
                while k < part.stop // PAGE:
                    row = decode_page(part.path, k, f.read_at(PAGE, k * PAGE).ljust(PAGE, b"\0"))
                    if row is not None and row[2] == "data":
                        return row[3]
                    k += 1
                return None

            a = first_place(part.start // PAGE, part.stop // PAGE, lambda k: self.range.before(time_of(k)))
            b = first_place(a, part.stop // PAGE, lambda k: not self.range.after(time_of(k)))
        return Range(part.path, a * PAGE, b * PAGE)

    def _pages(self, part: Range) -> Iterator[bytes]:
        if part.stop >= 0:
            yield from blocks(part.path, part.start, part.stop, PAGE)
            return
        files, name = file_system(part.path)
        with files.open_input_file(name) as raw, gzip.open(raw) as f:
            while len(page := f.read(PAGE)) == PAGE:
                yield page


class AxivitySource(DataSource):
    """spark.read.format("axivity").load(path): a file or a folder of .cwa or .cwa.gz files."""

    @classmethod
    def name(cls) -> str:
        return "axivity"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AxivityReader:
        return AxivityReader(self.options)


def between(pages: DataFrame, start: str, end: str, margin_seconds: float = 60) -> DataFrame:
    """The pages of AxivitySource whose samples may lie from start to end (device times), and those within a margin of them.

    The first page's samples are timed without the page before it; with a margin it lies outside the range.
    """
    at = lambda text: F.unix_micros(F.lit(text).cast("timestamp_ntz").cast("timestamp"))
    ends = pages.sparkSession.range(1).select(at(start).alias("a"), at(end).alias("b")).first()
    margin = int(margin_seconds * 1e6)
    return pages.where((F.col("time_us") >= ends["a"] - margin) & (F.col("time_us") <= ends["b"] + margin))


def samples(pages: DataFrame, shift_minutes: int = 0) -> DataFrame:
    """path, t (device time), x, y, z, temp of every sample of AxivitySource's pages.

    The first sample of a page is as far from the page before as its stamps and their places among the samples tell; where
    these are not plausible, it is found from the page's own stamp and rate.
    """
    by = Window.partitionBy("path").orderBy("page")
    data = pages.where("kind = 'data'").withColumns({"p_time": F.lag("time_us").over(by), "p_index": F.lag(F.col("time_index") - F.col("n")).over(by)})
    wide = F.when(F.col("n") > 80, 120).otherwise(80)  # samples that a page holds
    span = F.col("time_us") - F.col("p_time")
    alone = F.col("p_time").isNull() | (F.col("time_index") <= F.col("p_index")) | (span <= 0) | (span > 2e6 * wide / F.col("rate"))
    gap = span / (F.col("time_index") - F.col("p_index"))
    first = F.when(alone, F.col("time_us") - F.col("time_index") / F.col("rate") * 1e6).otherwise(F.col("p_time") - F.col("p_index") * gap)
    step = F.when(alone, 1e6 / F.col("rate")).otherwise(gap)
    rows = data.select("path", first.alias("first"), step.alias("step"), "temp", F.posexplode(F.arrays_zip("x", "y", "z")).alias("i", "v"))
    t = F.timestamp_micros((F.col("first") + F.col("i") * F.col("step")).cast("long") + shift_minutes * 60_000_000).cast("timestamp_ntz")
    return rows.select("path", t.alias("t"), "v.x", "v.y", "v.z", "temp")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AxivitySource)
    allow_pushdown(spark)
