"""Days of samples as gzipped .npy files, by a data source that commits whole writes only.

Tasks write under a folder of their write's own, and the driver moves their files into place when all have succeeded.  A task that
fails, is tried twice or runs twice leaves no file that is seen: only files of the attempts that Spark commits are moved,
and the folder goes with the rest of it.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import file_system

ROW = np.dtype([("time", "<i8"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4")])
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name while writing, final name, key, day, rows)."""

    files: list[tuple[str, str, str, str, int]]


class NpyWriter(DataSourceArrowWriter):
    """Rows (key, day, us, x, y, z) that are sorted by key, day and us; a file for each key and day."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.attempt = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = file_system(self.folder)
        done: list[tuple[str, str, str, str, int]] = []
        now, parts = None, []
        try:
            for batch in iterator:
                key, day = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (day[1:] != day[:-1]))) if batch.num_rows else []
                for a, b in zip(edges, np.append(edges[1:], batch.num_rows), strict=True) if len(edges) else ():
                    if now != (key[a], day[a]):
                        self._save(files, root, now, parts, done)
                        now, parts = (key[a], day[a]), []
                    rows = np.zeros(b - a, ROW)
                    part = batch.slice(a, b - a)
                    rows["time"] = part.column(2).to_numpy() * 1000
                    for c, axis in enumerate("xyz"):
                        rows[axis] = part.column(3 + c).to_numpy(zero_copy_only=False)
                    parts.append(rows)
            self._save(files, root, now, parts, done)
        except BaseException:
            for name, *_ in done:
                files.delete_file(f"{root}/{self.attempt}/{name}")
            raise
        return Written(done)

    def _save(self, files: pafs.FileSystem, root: str, now: tuple | None, parts: list[np.ndarray], done: list) -> None:
        if now is None:
            return
        plain, rows = io.BytesIO(), np.concatenate(parts)
        np.save(plain, rows)
        name, final = f"{uuid.uuid4().hex}.npy.gz", f"{now[0]}-{now[1]}.npy.gz"
        files.create_dir(f"{root}/{self.attempt}", recursive=True)
        with files.open_output_stream(f"{root}/{self.attempt}/{name}", compression=None) as f:
            f.write(gzip.compress(plain.getvalue()))
        done.append((name, final, str(now[0]), str(now[1]), len(rows)))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.folder)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(pafs.FileSelector(root)):
                if old.is_file:
                    files.delete_file(old.path)
        lines = []
        for name, final, key, day, n in (f for m in messages if m is not None for f in m.files):
            files.move(f"{root}/{self.attempt}/{name}", f"{root}/{final}")
            lines.append(json.dumps({"key": key, "day": day, "file": final, "n": n}))
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write("\n".join(lines).encode())
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, files: pafs.FileSystem, root: str) -> None:
        """What uncommitted attempts have left."""
        place = f"{root}/{self.attempt}"
        if files.get_file_info(place).type != pafs.FileType.NotFound:
            files.delete_dir(place)


class NpySource(DataSource):
    """df.write.format("npy_days").save(folder), for rows (key string, day string, us long, x, y, z double) in order."""

    @classmethod
    def name(cls) -> str:
        return "npy_days"

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def write_npy(samples: DataFrame, folder: str, key: str) -> DataFrame:
    """One gzipped .npy file per recording and day, of (time in ns, x, y, z); returns key, day, file, n.

    A day of 100 Hz samples, 170 MB, is the most that a task holds.  folder is a path or URI that executors can write; files of a
    write before go when the new one is committed.
    """
    spark = samples.sparkSession
    spark.dataSource.register(NpySource)
    axes = [F.coalesce(F.col(a).cast("double"), F.lit(float("nan"))).alias(a) for a in "xyz"]
    rows = samples.where("t IS NOT NULL").select(F.col(key).cast("string").alias("key"), F.to_date("t").cast("string").alias("day"), F.unix_micros(F.col("t").cast("timestamp")).alias("us"), *axes)
    rows.repartition("key", "day").sortWithinPartitions("key", "day", "us").write.format("npy_days").mode("overwrite").save(folder)
    return manifest(spark, folder).withColumnRenamed("key", key)


def read_npy(path: str) -> np.ndarray:
    files, name = file_system(path)
    with files.open_input_stream(name, compression=None) as f:
        return np.load(io.BytesIO(gzip.decompress(f.read())))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """key, day, file and n of the files that the last committed write has left."""
    return spark.read.schema("key string, day string, file string, n long").json(f"{folder}/{MANIFEST}")
