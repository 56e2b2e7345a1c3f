"""GENEActiv .bin recordings: pages of ten text lines, the tenth of hexadecimal samples.

The source returns a row per page; the samples are decoded by Spark's own functions.  Filters on time are pushed into the
source: page times rise through a file, so a range's first page is found by binary search over its bytes, and reading
stops after its last (option ordered=false reads all).  A file that cannot be read gives a row with an error, and the others go on.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import FAILED, file_system, listed
from .slices import TimeRange, allow_pushdown, first_place

HEADER_LINES, PAGE_LINES = 59, 10
SCHEMA = "path string, page long, time timestamp_ntz, temp double, rate double, payload string, gains array<double>, offsets array<double>, serial string, error string"
#: The first line of a page, and bytes within which the next one begins.
MARK, REACH = b"Recorded Data", 1 << 16


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def after_colon(line: str) -> str:
    return line.partition(":")[2].strip()


def page_time(line: str) -> datetime | None:
    try:
        return datetime.strptime(line.partition("Time:")[2].strip(), "%Y-%m-%d %H:%M:%S:%f")
    except ValueError:
        return None


class GeneactivReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.ordered = options.get("ordered", "true").lower() != "false"
        self.range = TimeRange("time")

    def pushFilters(self, filters):
        return self.range.push(filters)

    def partitions(self) -> list[File]:
        return [File(p) for p, _ in listed(self.path, (".bin",))]

    def read(self, part: File) -> Iterator[tuple]:
        try:
            yield from self._pages(part)
        except Exception as e:
            # timed within a pushed range, so that its filters keep the row
            yield part.path, None, self.range.inside(timedelta(microseconds=1)), None, None, None, [], [], None, f"{FAILED}{e}"

    def _pages(self, part: File) -> Iterator[tuple]:
        files, name = file_system(part.path)
        with files.open_input_file(name) as head, files.open_input_file(name) as raw:
            lines = (x.rstrip("\r\n") for x in io.TextIOWrapper(head, "latin-1"))
            header = [next(lines, "") for _ in range(HEADER_LINES)]
            start = self._first_page(raw) if self.ordered and self.range.low is not None else None
            number = lambda k: float(after_colon(header[k]) or 0)
            gains, offsets = [number(47), number(49), number(51)], [number(48), number(50), number(52)]
            serial, count = after_colon(header[1]), 0
            if start is not None:
                raw.seek(start)
                lines = (x.rstrip("\r\n") for x in io.TextIOWrapper(raw, "latin-1"))
            while page_lines := [x for _, x in zip(range(PAGE_LINES), lines, strict=False)]:
                if len(page_lines) < PAGE_LINES:
                    break  # cut short
                time = page_time(page_lines[3])
                if self.ordered and self.range.after(time):
                    break
                try:
                    temp, rate = float(after_colon(page_lines[5])), float(after_colon(page_lines[8]))
                except ValueError:
                    time = temp = rate = None
                sequence = after_colon(page_lines[2])
                yield part.path, int(sequence) if sequence.isdigit() else count, time, temp, rate, page_lines[9], gains, offsets, serial, None
                count += 1

    def _first_page(self, raw) -> int | None:
        """The place of the first page that is not before the range; None to begin with the first of all."""

        def page_from(at: int) -> tuple[int, datetime | None] | None:
            """(place, time) of the first page from a place on."""
            found = raw.read_at(REACH, at)
            k = found.find(MARK)
            while k > 0 and found[k - 1 : k] != b"\n":
                k = found.find(MARK, k + 1)
            if k < 0:
                return None
            lines = found[k:].decode("latin-1").split("\n", 4)
            return (at + k, page_time(lines[3])) if len(lines) == 5 else None

        size = raw.size()
        first = page_from(0)
        if first is None:
            return None
        at = first_place(first[0], size, lambda k: (p := page_from(k)) is not None and self.range.before(p[1]))
        found = page_from(at)
        return found[0] if found else size


class GeneactivSource(DataSource):
    """spark.read.format("geneactiv").load(path): a file or a folder of .bin files."""

    @classmethod
    def name(cls) -> str:
        return "geneactiv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeneactivReader:
        return GeneactivReader(self.options)


def signed_12bit(hexadecimal: Column) -> Column:
    """Three hexadecimal digits as a signed number; 2048 itself stays positive."""
    v = F.conv(hexadecimal, 16, 10).cast("int")
    return F.when(v > 2048, v - 4096).otherwise(v)


def samples(pages: DataFrame, shift_minutes: int = 0) -> DataFrame:
    """path, t, x, y, z, temp: twelve digits a sample, scaled by each axis' gain and offset."""
    good = pages.where("time IS NOT NULL AND rate > 0")
    n = F.expr("length(payload) div 12")
    rows = good.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))

    def axis(k: int) -> Column:
        raw = signed_12bit(F.substring(F.col("payload"), F.col("i") * 12 + 3 * k + 1, F.lit(3)))
        return (raw * 100.0 - F.col("offsets")[k]) / F.col("gains")[k]

    t = F.timestamp_micros(F.unix_micros(F.col("time").cast("timestamp")) + (F.col("i") * 1e6 / F.col("rate")).cast("long") + shift_minutes * 60_000_000).cast("timestamp_ntz")
    return rows.select("path", t.alias("t"), *(axis(k).alias(a) for k, a in enumerate("xyz")), "temp")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeneactivSource)
    allow_pushdown(spark)
