"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

A recording (16-bit PCM bytes) becomes pitch-class frames: the power of each short window, folded onto
the twelve pitch classes.  Rectangle filters over an integral image of these frames compare two areas each;
every comparison is quantised to two bits, and sixteen of them make one 32-bit integer per frame.

Recordings are aligned by an inverted index of neighbouring integers, two by two: a query looks its own up with up to
one bit of the 64 changed, and each find names a difference of positions.  There, equal integers vote, and of the
differences of a pair with enough votes, the one with the least share of differing bits is taken, where the two overlap
long enough.  Single integers recur by chance in all recordings, and their finds would grow with the square of the table.
A cut may lie between two frames, so queries are fingerprinted again from a few samples on.  Recordings with the same fingerprint are one class and are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, written

RATE = 4000
FRAME, HOP = 512, 256
LOWEST, HIGHEST = 110.0, 1800.0
WIDTH = 8  # frames under a filter
MIN_VOTES = 2
MIN_OVERLAP = 32
#: Samples that queries are fingerprinted from: no cut is farther than an eighth of a hop from one of them.
SHIFTS = (0, 64, 128, 192)
MAX_ERROR = 0.15

#: Sixteen filters by rule: (shape, first pitch class, pitch classes, frames).
FILTERS = tuple((k % 4, 3 * k % 9, 2 + k % 3, 2 + 2 * (k % 4)) for k in range(16))
#: Log ratios of a filter's areas are cut here; Gray codes of the four parts keep neighbours one bit apart.
CUTS, GRAY = (-0.35, 0.0, 0.35), (0, 1, 3, 2)


def pitch_map(rate: int = RATE) -> np.ndarray:
    """FFT bins x 12: which pitch class a bin counts for."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12))
    inside = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[inside, np.round(12 * np.log2(f[inside] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(signal: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12 of shares of power, of one recording's samples; no frames for less than one window."""
    n = (len(signal) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    window = np.hanning(FRAME)
    out, fold = np.zeros((n, 12)), pitch_map(rate)
    for at in range(0, n, 1024):
        m = min(1024, n - at)
        frames = np.lib.stride_tricks.sliding_window_view(signal[at * HOP : (at + m - 1) * HOP + FRAME], FRAME)[::HOP]
        out[at : at + m] = (np.abs(np.fft.rfft(frames * window, axis=1)) ** 2) @ fold
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for every position that all filters fit at."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for k, (shape, low, high, wide) in enumerate(FILTERS):
        top, half_p, half_t = low + high, low + high // 2, wide // 2
        whole = area(0, wide, low, top)
        if shape == 0:  # against all other pitch classes
            a, b = whole, area(0, wide, 0, 12) - whole
        elif shape == 1:  # lower against upper pitch classes
            a = area(0, wide, low, half_p)
            b = whole - a
        elif shape == 2:  # earlier against later frames
            a = area(0, half_t, low, top)
            b = whole - a
        else:  # the two diagonals
            a = area(0, half_t, low, half_p) + area(half_t, wide, half_p, top)
            b = whole - a
        part = np.searchsorted(CUTS, np.log((1 + a) / (1 + b)))
        out |= np.array(GRAY, dtype=np.uint32)[part] << np.uint32(2 * k)
    return out


def fingerprints(media: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", shift: int = 0) -> DataFrame:
    """rec_id and fp (32-bit integers, little-endian bytes) of each recording, from sample `shift` on; null or short audio has none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pcm in batch.column(1):
                data = pcm.as_py() or b""
                signal = np.frombuffer(data, dtype="<i2", count=len(data) // 2).astype(np.float64)
                out.append(fingerprint(chroma(signal[shift:])).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rec_id", "fp"])

    return mapped(media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(pcm_col).alias("pcm")), task, "rec_id long, fp binary")


def _neighbours(classes: DataFrame, name: str) -> DataFrame:
    """match_id under that name, and key (two neighbouring integers of fp in 64 bits) and pos of the first, by built-in functions."""
    n = F.octet_length("fp") / 4
    starts = F.when(n >= 2, F.sequence(F.lit(0), n.cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    at = classes.select(F.col("match_id").alias(name), "fp", F.explode(starts).alias("pos"))
    number = lambda k: F.conv(F.hex(F.expr(f"substring(fp, 4 * (pos + {k}) + 1, 4)")), 16, 10).cast("long")
    return at.select(name, F.shiftleft(number(0), 32).bitwiseOR(number(1)).alias("key"), "pos")


def _ball(key: str):
    """Rows for the key itself and for each key that one bit differs in."""
    return F.explode(F.array(F.col(key), *(F.col(key).bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64))))


def _class_pairs(media: DataFrame, id_col: str, pcm_col: str, every: int, min_votes: int, max_error: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(prints, classes, asked, pairs): pairs are of a query class and a class that it aligns with, its own included."""
    prints = written(fingerprints(media, id_col, pcm_col), "chroma-prints")
    known = prints.where("rec_id IS NOT NULL AND octet_length(fp) > 0")
    classes = written(known.groupBy("fp").agg(F.min("rec_id").alias("match_id"), F.count("*").alias("class_size")), "chroma-classes")
    asking = known.where(F.col("rec_id") % every == 0)
    asked = classes.select("fp", F.col("match_id").alias("query")).join(asking.groupBy("fp").agg(F.collect_set("rec_id").alias("query_ids")), "fp")
    asked = written(asked, "chroma-queries")

    query_of = asking.select("rec_id", "fp").distinct().join(asked.select("fp", "query"), "fp").select(F.col("rec_id").alias("r"), "query")
    again = media.where(F.col(id_col) % every == 0)
    shifted = [fingerprints(again, id_col, pcm_col, s).where("octet_length(fp) > 0").join(query_of, F.col("rec_id") == F.col("r")).select("query", F.lit(s).alias("shift"), "fp") for s in SHIFTS if s]
    views = asked.select("query", F.lit(0).alias("shift"), "fp")
    for x in shifted:
        views = views.union(x)
    views = written(views.distinct().withColumn("match_id", F.xxhash64("query", "shift", "fp")), "chroma-views")
    left = _neighbours(views, "view").join(views.select(F.col("match_id").alias("view"), "query"), "view").select("query", "view", F.col("pos").alias("query_pos"), _ball("key").alias("key"))
    met = left.join(_neighbours(classes, "match_id"), "key").where("query <> match_id")
    # a view and a class have fewer offsets than integers
    some = met.groupBy("query", "view", "match_id").agg(F.collect_set(F.col("pos") - F.col("query_pos")).alias("offsets"))
    pairs = some.join(views.select(F.col("match_id").alias("view"), "shift", F.col("fp").alias("query_fp")), "view").join(classes.select("match_id", "fp"), "match_id")
    best = F.min(F.struct("bit_error", F.abs("offset"), "offset", "shift", "votes")).alias("x")
    near = _errors(pairs, min_votes).where(F.col("bit_error") <= max_error).groupBy("query", "match_id").agg(best)
    near = near.select("query", "match_id", "x.offset", "x.shift", "x.votes", "x.bit_error")
    own = asked.select("query", F.col("query").alias("match_id"), F.lit(0).alias("offset"), F.lit(0).alias("shift"), (F.octet_length("fp") / 4).cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    return prints, classes, asked, near.unionByName(own)


def align(media: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", every: int = 100, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> DataFrame:
    """Aligns the recordings whose id `every` divides with all recordings.

    A row per query and class of recordings with one fingerprint that it aligns with, its own included:
    query_id, match_id (the class's least id), class_size, offset (frames that the match is ahead of the
    query, whose frames begin at sample shift), votes, bit_error (share of differing bits over the overlap).  Recordings without a fingerprint
    (null or short audio) align with nothing, null ids are never queries and count for no class; repeated
    rows count once each in class_size.
    """
    _, classes, asked, pairs = _class_pairs(media, id_col, pcm_col, every, min_votes, max_error)
    found = pairs.join(classes.select("match_id", "class_size"), "match_id").join(asked.select("query", F.explode("query_ids").alias("query_id")), "query")
    return found.select("query_id", "match_id", "class_size", F.col("offset").cast("long").alias("offset"), "shift", "votes", F.round("bit_error", 6).alias("bit_error"))


def aligned(media: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", every: int = 100, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> DataFrame:
    """A search: one row per row of media, with its class and the query classes that align with that.

    rec_id, class_id (the least id with its fingerprint), n_queries (how many queries it aligns with, itself among
    them if it is one), query_classes (the least ids of all their classes, in order; on the rows whose rec_id is the class_id, as it is the
    same for all of a class), and of the query that aligns best, by bit errors and then id: best_query, offset, bit_error.
    Nulls where there is no fingerprint, or no query.  Audio may be of any length; silence is a fingerprint like any other.
    """
    prints, classes, asked, pairs = _class_pairs(media, id_col, pcm_col, every, min_votes, max_error)
    who = asked.select("query", F.size("query_ids").cast("long").alias("n"), F.array_min("query_ids").alias("best_query"))
    best = F.struct(F.round("bit_error", 6).alias("bit_error"), "best_query", F.col("offset").cast("long").alias("offset"))
    each = pairs.join(who, "query").groupBy("match_id").agg(F.sum("n").alias("n_queries"), F.array_sort(F.collect_list("query")).alias("query_classes"), F.min(best).alias("best"))
    found = classes.join(each, "match_id", "left").withColumnRenamed("fp", "class_fp")
    rows = prints.join(found, prints.fp == F.col("class_fp"), "left")
    inside = F.col("rec_id").isNotNull()
    return rows.select(
        "rec_id", F.when(inside, F.col("match_id")).alias("class_id"), F.when(inside, F.coalesce("n_queries", F.lit(0))).otherwise(0).cast("long").alias("n_queries"),
        F.when(inside & (F.col("rec_id") == F.col("match_id")), F.col("query_classes")).alias("query_classes"),
        *(F.when(inside, F.col(f"best.{c}")).alias(c) for c in ("best_query", "offset", "bit_error")),
    )


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits of two fingerprints where b, shifted by offset, overlaps a; 1 where that is too short.

    The overlap has to be MIN_OVERLAP integers, or the whole of the shorter fingerprint.
    """
    i, j = max(0, -offset), max(0, offset)
    n = min(len(a) - i, len(b) - j)
    if n < min(MIN_OVERLAP, len(a), len(b)) or n < 1:
        return 1.0
    return float(np.bitwise_count(a[i : i + n] ^ b[j : j + n]).sum() / (32 * n))


def votes_at(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """How many integers of two fingerprints are equal where b is shifted by offset."""
    i, j = max(0, -offset), max(0, offset)
    n = min(len(a) - i, len(b) - j)
    return int((a[i : i + n] == b[j : j + n]).sum()) if n > 0 else 0


def _errors(pairs: DataFrame, min_votes: int) -> DataFrame:
    """Of each pair's offsets with enough votes, the one with the least bit error, nearer ones first; an error of 2 without one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: np.frombuffer(x, dtype="<u4")
        for batch in slices(batches):
            best = []
            for a, b, offsets in zip(*(batch.column(n).to_pylist() for n in ("query_fp", "fp", "offsets")), strict=True):
                x, y = read(a), read(b)
                counted = ((o, votes_at(x, y, o)) for o in offsets)
                best.append(min(((bit_error(x, y, o), abs(o), o, v) for o, v in counted if v >= min_votes), default=(2.0, 0, 0, 0)))
            columns = [pa.array([r[k] for r in best], t) for k, t in ((2, pa.int32()), (3, pa.int64()), (0, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("query", "match_id", "shift")), *columns], ["query", "match_id", "shift", "offset", "votes", "bit_error"])

    return mapped(pairs.select("query", "match_id", "shift", "query_fp", "fp", "offsets"), task, "query long, match_id long, shift int, offset int, votes long, bit_error double")


def sonify(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A media table (rec_id, pcm) from a table of vectors: each component is a note, its size the pitch.

    A stand-in for recordings, which the given tables do not hold: notes of HOP samples on a scale of
    semitones around 440 Hz, one per component; a null vector is silence of no length.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(HOP) / RATE
        scale = np.stack([np.sin(2 * np.pi * 440.0 * 2 ** (k / 12) * t) for k in range(-12, 12)]) * 12_000
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                notes = [np.clip(np.rint(np.nan_to_num(np.array(v or [], dtype=float)) / 0.04) + 12, 0, 23).astype(int) for v in part.column(1).to_pylist()]
                pcm = [scale[k].reshape(-1).astype("<i2").tobytes() for k in notes]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pcm, pa.binary())], ["rec_id", "pcm"])

    return mapped(vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.col(vector_col).alias("v")), task, "rec_id long, pcm binary")
