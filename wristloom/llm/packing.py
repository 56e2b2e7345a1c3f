"""Harmonic packing of token ids into sequences of a fixed capacity.

Harmonic packing puts a length in (C/(k+1), C/k] into class k and gives every bin of that class k
pieces, so workers fill bins without talking to each other.  Its waste is what the lengths of a class
fall short of C/k.  As documents may be cut, they are cut where a class has no waste: the longest piece
floor(C/k) that fits the rest of a document, again and again, until the rest is short.  What is left
after a cut is below (rest squared)/C, so a document has about three pieces beyond its full sequences.
All pieces of a class have the same length, so the n-th piece of class k lies in the class's bin
floor(n/k), at offset (n mod k) * length: places come from counting alone.

Only the last bin of a class can be part-filled.  There are fewer classes than 2 * sqrt(C) + SHORT, at
any input size; the pieces of these last bins are laid into shared sequences by first fit, on the
driver, over that bounded list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, slices, written
from .tokens import END_ID, WORD_BPE, encoder

CAPACITY = 4096
#: Rests up to this length stay whole; each such length is a class of its own.
SHORT = 63


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, each floor(capacity / k) for some k."""
    short = min(SHORT, int(capacity**0.5))
    pieces = [capacity] * (n_tokens // capacity)
    rest = n_tokens % capacity
    while rest > short:
        pieces.append(capacity // -(-capacity // rest))
        rest -= pieces[-1]
    return pieces + [rest] * (rest > 0)


def pieces(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, and its number among the pieces of its length in its task."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], dtype="<u4").tobytes()
        counts: dict[int, int] = {}
        me = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(ids + tail)
                at, n = 0, len(ids) // 4
                for length in cut(n, capacity):
                    k = counts.get(length, 0)
                    counts[length] = k + 1
                    rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, me, k))
                    at += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(source, task, ", ".join(f"{n} long" for n in names))


def first_fit(left: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Places (length, count) groups of equal pieces, longest first: (length, n-th piece, bin, offset)."""
    filled: list[int] = []
    out = []
    for length, count in sorted(left, reverse=True):
        for n in range(count):
            b = next((b for b, used in enumerate(filled) if used + length <= capacity), len(filled))
            if b == len(filled):
                filled.append(0)
            out.append((length, n, b, filled[b]))
            filled[b] += length
    return out


def harmonic_pack(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Packs docs (doc_id, text): one row per piece with its sequence_id and its offset there.

    A null text is an empty one, of the end id alone.  Rows are packed one by one: repeated rows and null
    doc_ids are documents like any other.  No rows give no pieces.  Other columns are not read.
    """
    spark = docs.sparkSession
    cuts = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")

    # one row per class: at most 2 * sqrt(capacity) + SHORT of them
    classes = {r["length"]: r["total"] for r in bases.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    first, plan, left = 0, [], []
    for length, total in sorted(classes.items(), reverse=True):
        k = capacity // length
        plan.append((length, k, first, total // k * k))
        first += total // k
        left.append((length, total % k))
    full = spark.createDataFrame(plan, "length long, k long, first long, in_full long")
    rest = spark.createDataFrame([(a, n, first + b, at) for a, n, b, at in first_fit(left, capacity)], "length long, nth long, rest_id long, rest_offset long")

    n = F.col("base") + F.col("number")
    placed = cuts.join(bases.drop("n"), ["task", "length"]).withColumn("nth", n).join(F.broadcast(full), "length")
    last = F.broadcast(rest.withColumnRenamed("nth", "rest_nth"))
    placed = placed.withColumn("rest_nth", F.col("nth") - F.col("in_full")).join(last, ["length", "rest_nth"], "left")
    inside = F.col("nth") < F.col("in_full")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(inside, F.expr("first + nth div k")).otherwise(F.col("rest_id")).alias("sequence_id"),
        F.when(inside, F.expr("nth % k * length")).otherwise(F.col("rest_offset")).alias("offset"),
    )
