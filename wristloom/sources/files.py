"""Finding recordings, and reading their bytes on executors."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFormat

#: What the error of a file starts with that a source cannot go on with; errors of single pages do not.
FAILED = "failed: "
FORMATS = {".cwa": "axivity", ".bin": "geneactiv", ".gt3x": "actigraph", ".csv": "csv"}
COMPRESSIONS = (".gz", ".zip", ".bz2", ".xz")


def format_of(path: str) -> str:
    """The source for a path, by its suffix in any case, a compression's suffix aside."""
    name = path.lower()
    for c in COMPRESSIONS:
        name = name.removesuffix(c)
    for suffix, source in FORMATS.items():
        if name.endswith(suffix):
            return source
    raise UnsupportedFormat(path)


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str, suffixes: tuple[str, ...], recursive: bool = True) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, or of a file, whose names end so, in order of their paths."""
    files, root = file_system(path)
    info = files.get_file_info(root)
    found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root, recursive=recursive))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.path.lower().endswith(suffixes))


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = tuple(FORMATS), recursive: bool = True) -> DataFrame:
    """(path, length) of the recordings under a folder, compressed ones too, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    pattern = "(?i)(" + "|".join(e.replace(".", r"\.") for e in extensions) + r")(\.(gz|zip|bz2|xz))?$"
    return files.where(F.col("path").rlike(pattern)).orderBy("path")


def blocks(path: str, start: int, stop: int, size: int) -> Iterator[bytes]:
    """Whole blocks of a file from byte start to stop, read a megabyte at a time."""
    files, name = file_system(path)
    step = max(size, (1 << 20) // size * size)
    with files.open_input_file(name) as f:
        for at in range(start, stop, step):
            data = f.read_at(min(step, stop - at), at)
            for k in range(0, len(data) - size + 1, size):
                yield data[k : k + size]
