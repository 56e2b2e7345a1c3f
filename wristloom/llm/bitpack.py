"""Token ids in files, bit-packed at a fixed width.

A shard file holds the ids of some documents, one after the other:

    magic `TIDBITS1` | payload: blocks of packed ids, each padded to 8 bytes | footer | u64 footer size | magic

The footer is five u64 (bits per id, ids per block, ids, documents, blocks), then the blocks' byte
offsets (u64, one more than blocks), the documents' first ids (u64, one more than documents), their
doc_ids (i64) and a byte for each that is 0 where the doc_id is null.  All numbers are little-endian.
Id k of a block is bits k*width to (k+1)*width of the block, lowest bit first, so that 64 ids always
fill whole 64-bit words: packing and unpacking are 64 vector steps, whatever the number of ids, and
any id range is read from the blocks that hold it and from no others.

Writers stream blocks, so a task holds one Arrow batch, one open block and the document table.  Every
task attempt writes a file of its own and names it in the row it returns; files of attempts that were
lost are in no manifest and are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, shared_path, slices, written
from .tokens import END_ID, WORD_BPE, encoder

MAGIC = b"TIDBITS1"
BLOCK_IDS = 8192  # a multiple of 64


def width_for(vocab_size: int) -> int:
    """The bits that the largest id of a vocabulary needs."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, below 2**bits, as packed 64-bit words; zero ids fill the last 64."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), dtype="<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of packed words."""
    groups = len(data) // (8 * bits)
    packed = np.frombuffer(data, dtype="<u8").reshape(groups, bits)
    out = np.empty((groups, 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (packed[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = value & mask
    return out.reshape(-1)[:count]


class ShardWriter:
    """Streams documents' ids into one file."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.open = np.empty(0, dtype=np.uint32)
        self.offsets, self.starts, self.docs, self.valid = [0], [0], [], bytearray()
        sink.write(MAGIC)

    def add(self, docs: list[int | None], ids: list[np.ndarray]) -> None:
        for doc, x in zip(docs, ids, strict=True):
            self.docs.append(doc or 0)
            self.valid.append(doc is not None)
            self.starts.append(self.starts[-1] + len(x))
        self.open = np.concatenate([self.open, *ids])
        full = len(self.open) // self.block_ids * self.block_ids
        for at in range(0, full, self.block_ids):
            self._block(self.open[at : at + self.block_ids])
        self.open = self.open[full:].copy()

    def _block(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} needs more than {self.bits} bits")
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if len(self.open):
            self._block(self.open)
        footer = struct.pack("<5Q", self.bits, self.block_ids, self.starts[-1], len(self.docs), len(self.offsets) - 1)
        footer += np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes()
        footer += np.array(self.docs, "<i8").tobytes() + bytes(self.valid)
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.sink.close()


class ShardReader:
    """Random access to a shard file; only the footer and the blocks asked for are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16) if size >= 16 else b""
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard, or cut short")
        (n,) = struct.unpack("<Q", tail[:8])
        footer = source.read_at(n, size - 16 - n)
        self.bits, self.block_ids, self.n_ids, n_docs, n_blocks = struct.unpack_from("<5Q", footer)
        at = 40
        self.offsets = np.frombuffer(footer, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.starts = np.frombuffer(footer, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.docs = np.frombuffer(footer, "<i8", n_docs, at)
        self.valid = np.frombuffer(footer, "u1", n_docs, at + 8 * n_docs).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, exclusive, of the shard."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        low, high = int(self.offsets[first]), int(self.offsets[last + 1])
        data = self.source.read_at(high - low, len(MAGIC) + low)
        # all blocks but the shard's last are full, so neighbours unpack as one
        return unpack(data, self.bits, stop - first * self.block_ids)[start - first * self.block_ids :]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) in order, reading about at_once ids at a time."""
        k, n = 0, len(self.docs)
        while k < n:
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, "right")) - 1)
            base = int(self.starts[k])
            ids = self.ids(base, int(self.starts[stop]))
            for i in range(k, stop):
                a, b = int(self.starts[i]), int(self.starts[i + 1])
                yield (int(self.docs[i]) if self.valid[i] else None), a, ids[a - base : b - base]
            k = stop


def open_fs(path: str):
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order into shard files under path.

    Returns the manifest, one row per file: shard, file, n_docs, n_ids, start (ids of all shards before).
    A null text is an empty one; a null doc_id sorts first; rows with the same doc_id are in the order of
    their texts.  The order is a range partitioning on doc_id, so files are ordered as their numbers are.
    """
    bits = max(width_for(encoder(tokenizer).vocab_size), width_for(end_id + 1))
    tail = np.array([end_id], dtype=np.uint32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_fs(path)
        writer = None
        where = TaskContext.get()
        shard, file = where.partitionId(), f"shard-{where.partitionId():06d}-{where.taskAttemptId()}.tid"
        for batch in slices(batches):
            if writer is None:
                files.create_dir(folder, recursive=True)
                writer = ShardWriter(files.open_output_stream(f"{folder}/{file}"), bits)
            ids = encoder(tokenizer).encode(batch.column(1).to_pylist())
            writer.add(batch.column(0).to_pylist(), [np.concatenate([np.frombuffer(x, "<u4"), tail]) for x in ids])
        if writer is not None:
            writer.close()
            row = [[shard], [file], [len(writer.docs)], [writer.starts[-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "file", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = written(mapped(ordered, task, "shard long, file string, n_docs long, n_ids long"), "shards")
    # one row per file, so one task can sum them
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_fs(path)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{folder}/{row['file']}") as source:
                    rows = ((doc, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in ShardReader(source).documents())
                    while part := list(islice(rows, 20_000)):
                        columns = zip(*part, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file: a given number of partitions is not merged at run time
    spread = manifest.select("file", "start", "shard").repartition(max(1, manifest.count()))
    return mapped(spread, task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes docs' ids to files in the shared folder, or under path, and reads them back: a row per row of docs.

    A null or empty text has the end id alone; a null doc_id comes first; rows of one doc_id are in the order of their
    texts; no rows give none.  Texts are whole, however long, and other columns are not read.
    """
    path = path or shared_path(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, path, tokenizer, end_id), path)
