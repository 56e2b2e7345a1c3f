"""ActiGraph .gt3x recordings: a zip of info.txt and activity.bin (older) or log.bin (newer).

The source returns a row per packet, samples as arrays; a zip has one reader, so files are the partitions.  Filters on start_ms are
pushed into the source: packets before the range are not decoded, and reading stops after it (option ordered=false reads all).
A file that cannot be read gives a row with an error, and the others go on, but for mode FAILFAST.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import xor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InvalidInput
from .files import FAILED, file_system, listed
from .slices import TimeRange, allow_pushdown

SCHEMA = "path string, packet long, start_ms long, rate double, x array<double>, y array<double>, z array<double>, serial string, error string"
#: Counts per g by the first letters of a serial number.
SCALES = {"NEO": 341.0, "CLE": 341.0, "MOS": 256.0}
ACTIVITY, PARAMETERS, ACTIVITY2 = 0, 21, 26
PAIRS_AT_ONCE = 5000


def parse_info(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, sep, v in (line.partition(": ") for line in text.splitlines()) if sep}


def version(names: list[str]) -> int:
    """1 for activity, lux and info; 2 for info and log."""
    found = set(names)
    if {"activity.bin", "lux.bin", "info.txt"} <= found:
        return 1
    if {"info.txt", "log.bin"} <= found:
        return 2
    raise InvalidInput(f"no recording in {sorted(found)}")


def ticks_millis(ticks: int) -> int:
    return (ticks - 621355968000000000) // 10_000


def shift_millis(text: str | None) -> int:
    """`±HH:MM:SS` in milliseconds; the sign holds for all parts."""
    if not text:
        return 0
    parts = [float(x) for x in text.lstrip("+-").split(":")]
    total = int(sum(x * u for x, u in zip(parts, (3600, 60, 1), strict=False)) * 1000)
    return -total if text.startswith("-") else total


def unpack_12bit(data: bytes) -> np.ndarray:
    """Big-endian signed 12-bit numbers, two in three bytes; a rest of under 12 bits is dropped."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    n = len(b) * 8 // 12
    b = np.concatenate([b, np.zeros(3, np.int32)])
    at = np.arange(n) * 3 // 2
    v = np.where(np.arange(n) % 2 == 0, b[at] << 4 | b[at + 1] >> 4, (b[at] & 15) << 8 | b[at + 1])
    return v - ((v & 0x800) << 1)


def decode_parameter(value: int) -> float:
    """A number of 24 signed bits over 2**23, times two to the power of 8 signed bits above them."""
    fraction, power = value & 0xFFFFFF, value >> 24 & 0xFF
    fraction -= (fraction & 0x800000) << 1
    power -= (power & 0x80) << 1
    return fraction / 2.0**23 * 2.0**power


def rounded(v: np.ndarray) -> np.ndarray:
    return np.floor(v * 1000 + 0.5) / 1000


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ActigraphReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.ordered = options.get("ordered", "true").lower() != "false"
        self.range = TimeRange("start_ms")

    def pushFilters(self, filters):
        return self.range.push(filters)

    def partitions(self) -> list[File]:
        return [File(p) for p, _ in listed(self.path, (".gt3x",))]

    def read(self, part: File) -> Iterator[tuple]:
        try:
            yield from self._rows(part)
        except Exception as e:
            if self.strict:
                raise
            # timed within a pushed range, so that its filters keep the row
            yield part.path, None, self.range.inside(1), None, [], [], [], None, f"{FAILED}{e}"

    def _rows(self, part: File) -> Iterator[tuple]:
        files, name = file_system(part.path)
        with files.open_input_file(name) as raw, zipfile.ZipFile(raw) as z:
            kind = version(z.namelist())
            info = parse_info(z.read("info.txt").decode("latin-1"))
            serial, rate = info.get("Serial Number", ""), float(info.get("Sample Rate", 30))
            scale = float(info.get("Acceleration Scale") or next((v for k, v in SCALES.items() if serial.startswith(k)), 256.0))
            shift = shift_millis(info.get("TimeZone"))
            if kind == 1:
                start = ticks_millis(int(info["Start Date"])) - shift
                rows = self._pairs(z.open("activity.bin"), start, rate, scale)
            else:
                rows = self._packets(z.open("log.bin"), shift, rate, scale)
            for k, (ms, xyz, error) in enumerate(rows):
                if xyz is None:
                    continue  # not in the range
                x, y, zz = xyz.T.tolist() if len(xyz) else ([], [], [])
                yield part.path, k, ms, rate, x, y, zz, serial, error

    def _pairs(self, f: io.BufferedIOBase, start: int, rate: float, scale: float) -> Iterator[tuple]:
        """Nine bytes are two samples, each y, x, z; the first is at the start."""
        done = 0
        while data := f.read(9 * PAIRS_AT_ONCE):
            first, n = start + round(1000 * done / rate), len(data) // 9 * 2
            if self.ordered and self.range.after(first):
                return
            done += n
            if not self.range.holds(first):
                yield first, None, None
            elif n:
                yield first, unpack_12bit(data[: n // 2 * 9]).reshape(-1, 3)[:, [1, 0, 2]] / scale, None

    def _packets(self, f: io.BufferedIOBase, shift: int, rate: float, scale: float) -> Iterator[tuple]:
        """Packets of separator, type, seconds, size, payload and checksum; samples start one period after the second."""
        none = np.zeros((0, 3))
        while len(head := f.read(8)) == 8:
            separator, kind, date, size = struct.unpack("<BBIH", head)
            body, check = f.read(size), f.read(1)
            if len(body) < size or not check:
                return
            if ~reduce(xor, head + body) & 0xFF != check[0]:
                if self.strict:
                    raise InvalidInput("a packet's checksum does not match")
                yield None, none, "checksum"
                continue
            first = date * 1000 + round(1000 / rate) - shift
            if kind == PARAMETERS:
                for at in range(0, size - 7, 8):
                    space, _, ident = body[at], body[at + 1], body[at + 2]
                    if space == 0 and ident == 55:
                        scale = decode_parameter(struct.unpack_from("<I", body, at + 4)[0])
            elif kind in (ACTIVITY, ACTIVITY2) and size > 1 and not self.range.holds(first):
                if self.ordered and self.range.after(first):
                    return
                yield first, None, None
            elif kind == ACTIVITY and size > 1:
                v = unpack_12bit(body)
                yield first, rounded(v[: len(v) // 3 * 3].reshape(-1, 3)[:, [1, 0, 2]] / scale), None
            elif kind == ACTIVITY2 and size > 1:
                v = np.frombuffer(body[: size // 6 * 6], "<i2").reshape(-1, 3)
                yield first, rounded(v / scale), None


class ActigraphSource(DataSource):
    """spark.read.format("actigraph").load(path): a file or a folder of .gt3x files; mode FAILFAST raises on bad packets."""

    @classmethod
    def name(cls) -> str:
        return "actigraph"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ActigraphReader:
        return ActigraphReader(self.options)


def samples(packets: DataFrame) -> DataFrame:
    """path, t, x, y, z, temp (unknown: 1) of every sample."""
    rows = packets.where("error IS NULL").select("path", "start_ms", "rate", F.posexplode(F.arrays_zip("x", "y", "z")).alias("i", "v"))
    t = F.timestamp_millis(F.col("start_ms") + F.round(F.col("i") * 1000 / F.col("rate")).cast("long")).cast("timestamp_ntz")
    return rows.select("path", t.alias("t"), "v.x", "v.y", "v.z", F.lit(1.0).alias("temp"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ActigraphSource)
    allow_pushdown(spark)
