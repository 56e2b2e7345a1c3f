"""Suffix-array dedup: later copies of repeated passages go, by longest-previous-factor arrays.

The longest previous factor of a suffix is its longest common prefix with a suffix of an earlier document.  In suffix
order it is one of two: that with the nearest suffix before it, or with the nearest one after it, that belongs to an
earlier document (Crochemore and Ilie, 2008).  Bytes go that a long enough factor covers.

One suffix array of all texts would hold a place for every byte.  Suffixes that cannot have a factor of `length` bytes
are left out by an exact rule: the least (by hash) 16-byte gram of every window of `length` bytes depends on nothing but
the window, so equal windows have equal grams, and a window whose gram is in one document alone has no copy.
The same gram says which windows are sorted together:

1. Documents are dealt into buckets of a fixed number.  Each bucket sends every gram it holds once.  A text that an earlier
   document has as a whole is known by its hashes: it goes, and takes no part in the rest.
2. Grams in two documents or more go back to the buckets, which cut those windows out: a run of windows with the same gram
   is one piece of text.  Copies within a bucket are settled there.  Pieces are dealt by gram; if there are more than HOT of a
   gram (what follows a very common passage, common words), each of its windows is a piece of its own, dealt by all its bytes.
3. A task orders the suffixes of a gram's pieces, takes their longest previous factors, and sends back what goes.

No key gets more than a row per bucket (windows, grams) or HOT pieces, however common a passage is.
The buckets' texts are shuffled once, compressed, and read by all three steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: Bytes of a gram; documents and bytes of texts of a bucket, on average; pieces above which a gram's windows are dealt one by one.
GRAM, BUCKET, BUCKET_BYTES, HOT = 16, 2048, 1 << 24, 1 << 16
#: Positions that are hashed at once (below 2 ** PLACE), most windows of a piece, suffixes that are sorted at once, and rows of sorted keys taken at once.
CHUNK, PLACE, PIECE, SORTED, ROWS = 1 << 17, 18, 4096, 1 << 17, 1 << 14
_ODD = 0x9E3779B97F4A7C15


def _gram_hashes(x: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each `size` bytes of x (a power of two), by doubling."""
    h, have = x.astype(np.uint64) + np.uint64(1), 1
    while have < size:
        h = h[:-have] * np.uint64(pow(_ODD, have, 1 << 64)) + h[have:]
        have *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        v, have = np.minimum(v[:-have], v[have:]), have * 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def window_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, start, n): runs of n windows from start on that have the same gram, of texts that end at `ends` in data.

    Windows lie within a text; each is in exactly one run.  Of equal grams of a window it does not matter which is meant.
    """
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(starts, ends - length + 1), 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge)[:-1] == 0
    grams, at, size = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    low = np.uint64((1 << PLACE) - 1)
    for c in range(0, len(data) - length + 1, CHUNK):
        g = _gram_hashes(data[c : c + CHUNK + length - 1])
        # the place in the low bits: the least value says where its gram is, the first of equal ones
        v = _least((g & ~low) | np.arange(len(g), dtype=np.uint64), length - GRAM + 1)
        h, ok = g[(v & low).astype(np.int64)], inside[c : c + len(v)]
        begin = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (ok[1:] != ok[:-1])) + 1])
        n = np.diff(np.append(begin, len(v)))
        begin, n = begin[ok[begin]], n[ok[begin]]
        parts = -(-n // PIECE)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, n = np.repeat(begin, parts) + part * PIECE, np.minimum(np.repeat(n, parts) - part * PIECE, PIECE)
        grams.append(h[begin])
        at.append(begin + c)
        size.append(n)
    return np.concatenate(grams), np.concatenate(at), np.concatenate(size)


def _window_hashes(data: np.ndarray, at: np.ndarray, length: int, at_once: int = 1 << 14) -> np.ndarray:
    """A hash of the `length` bytes from each place on."""
    powers = np.array([pow(_ODD, k, 1 << 64) for k in range(length)], dtype=np.uint64)
    out = np.empty(len(at), dtype=np.uint64)
    for a in range(0, len(at), at_once):
        part = at[a : a + at_once]
        out[a : a + at_once] = ((data[part[:, None] + np.arange(length)] + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64)
    return out ^ (out >> np.uint64(32))


def suffix_order(suffixes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, all of one length, and of documents where they are equal."""
    padded = np.zeros((len(suffixes), -(-suffixes.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : suffixes.shape[1]] = suffixes
    words = padded.view(">u8")
    return np.lexsort([doc, *words.T[::-1]])


def _nearest_smaller(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it that is of an earlier document; 0 if below least.

    doc is in suffix order, and lcp[i] is what suffixes i - 1 and i have in common.  A suffix points to one before it such
    that none between is of an earlier document; pointers follow each other until they end there.
    """
    to, reach = np.arange(len(doc)) - 1, lcp.copy()
    reach[:1] = 0
    live = np.flatnonzero(reach >= least)
    live = live[doc[to[live]] >= doc[live]]
    while len(live):
        next_reach, next_to = np.minimum(reach[live], reach[to[live]]), to[to[live]]
        reach[live], to[live] = next_reach, next_to
        live = live[next_reach >= least]
        live = live[doc[to[live]] >= doc[live]]
    return np.where(reach >= least, reach, 0)


def longest_previous_factors(suffixes: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each row of bytes, its longest common prefix with one of a smaller doc; 0 if that is below least."""
    order = suffix_order(suffixes, doc)
    ordered, d = suffixes[order], doc[order]
    unlike = ordered[1:] != ordered[:-1]
    lcp = np.concatenate([[0], np.where(unlike.any(axis=1), unlike.argmax(axis=1), suffixes.shape[1])])
    before = _nearest_smaller(d, lcp, least)
    after = _nearest_smaller(d[::-1], np.concatenate([[0], lcp[:0:-1]]), least)[::-1]
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


# ---------------------------------------------------------------- what tasks do


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, a text, is compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(t or b"") for t in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], ["bucket", "own", "doc_id", "text"])


def _rows(table: pa.Table) -> list[tuple[int | None, bytes, int]]:
    """(doc_id, text, own) of a bucket by rising doc_id, in one order whatever order its rows came in."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = zip(table.column("doc_id").to_pylist(), map(unpack, table.column("text").to_pylist()), table.column("own").to_pylist(), strict=True)
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _open(rows: list, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, doc_id, data, ends) of those rows that have a doc_id and are no copies of an earlier document."""
    gone = set(copies.tolist())
    at = [k for k, (d, _, own) in enumerate(rows) if d is not None and own not in gone]
    texts = [rows[k][1] for k in at]
    return np.array(at, dtype=np.int64), np.array([rows[k][0] for k in at], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _grams_task(length: int):
    def task(table: pa.Table, copies: pa.Table) -> pa.Table:
        _, doc, data, ends = _open(_rows(table), copies.column("own").to_numpy())
        h, at, _ = window_runs(data, ends, length)
        # a gram counts once for every doc_id
        own = doc[np.searchsorted(ends, at, side="right")] if len(at) else np.zeros(0, dtype=np.int64)
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, dtype=bool)
        gram, begin, n = np.unique(h[new], return_index=True, return_counts=True)
        many = np.diff(np.append(np.flatnonzero(new)[begin], len(h))) if len(gram) else n
        bucket = np.full(len(gram), table.column("bucket")[0].as_py() if table.num_rows else 0, dtype=np.int32)
        return pa.table({"gram": pa.array(gram.view(np.int64)), "bucket": pa.array(bucket), "n": pa.array(n.astype(np.int32)), "pieces": pa.array(many.astype(np.int32))})

    return task


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of some ROWS rows that hold all rows of their keys, the first column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if rows >= ROWS and (key[0] != key[-1] or held[-1].column(0)[-1].as_py() != key[0]):
            last = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held, rows, batch = [], 0, batch.slice(last)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared_task(hot: int):
    """Sorted (gram, bucket, n, pieces) to (bucket, value, kind) of the grams in two documents or more: their kind is hot or not."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            gram, bucket, n, pieces = (table.column(k).to_numpy() for k in range(4))
            begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            docs, many = (np.repeat(np.add.reduceat(c.astype(np.int64), begin), np.diff(np.append(begin, len(gram)))) for c in (n, pieces))
            keep = docs > 1
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(gram[keep]), pa.array((many[keep] > hot).astype(np.int8))], ["bucket", "value", "kind"])

    return task


PIECES = "key long, doc long, place long, span long, piece binary"
#: Marks of a bucket: a gram's hash, one of a hot gram, or the row that is a copy.
NORMAL, OFTEN, COPY = 0, 1, 2
#: span is the start of a piece, and its windows in the lower bits.
BITS = 31
_MASK = (1 << BITS) - 1


def _pieces_task(length: int):
    """A bucket's texts and marks to PIECES: place is the bucket and the row in it, span the start and the number of windows.

    What an earlier document of the bucket has, and copies, come without bytes, neighbouring pieces as one: they go anyway.
    """

    def task(table: pa.Table, marks: pa.Table) -> pa.Table:
        value, kind = marks.column("value").to_numpy(), marks.column("kind").to_numpy()
        rows = _rows(table) if len(value) else []
        copies = value[kind == COPY]
        open_, doc, data, ends = _open(rows, copies)
        h, at, n = window_runs(data, ends, length)
        gram, hot = value[kind != COPY].view(np.uint64), kind[kind != COPY] == OFTEN
        order = np.argsort(gram)
        gram, hot = gram[order], hot[order]
        found = np.minimum(np.searchsorted(gram, h), len(gram) - 1) if len(gram) else np.zeros(len(h), dtype=np.int64)
        ok = gram[found] == h if len(gram) else np.zeros(len(h), dtype=bool)
        h, at, n, hot = h[ok], at[ok], n[ok], hot[found[ok]]
        # each window of a hot gram is a piece, its key a hash of all its bytes
        many = np.where(hot, n, 1)
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        h, at, n, hot = np.repeat(h, many), np.repeat(at, many) + part, np.repeat(np.where(hot, 1, n), many), np.repeat(hot, many)
        h[hot] = _window_hashes(data, at[hot], length)
        inner = np.searchsorted(ends, at, side="right")
        start, ids = at - np.concatenate([[0], ends[:-1]])[inner], doc[inner]
        raw, first, pieces = data.tobytes(), {}, []
        for a, b, d in zip(at.tolist(), (at + n + length - 1).tolist(), ids.tolist(), strict=True):
            piece = raw[a:b]
            pieces.append(piece if first.setdefault(piece, d) == d else None)  # by rising doc_id, so the first is the least
        gone = np.array([p is None for p in pieces], dtype=bool)
        # settled: pieces that follow each other are one, and whole copies are one each
        after = np.append(False, gone[:-1] & gone[1:] & (at[1:] == at[:-1] + n[:-1]))
        begin = np.flatnonzero(gone & ~after)
        total = np.add.reduceat(np.where(gone, n, 0), begin) if len(begin) else np.zeros(0, dtype=np.int64)
        again = set(copies.tolist())
        whole = [k for k, (_, text, own) in enumerate(rows) if own in again and len(text) >= length]
        keep = np.flatnonzero(~gone)
        row = np.concatenate([open_[inner[keep]], open_[inner[begin]], np.array(whole, dtype=np.int64)])
        start = np.concatenate([start[keep], start[begin], np.zeros(len(whole), dtype=np.int64)])
        n = np.concatenate([n[keep], total, np.array([len(rows[k][1]) - length + 1 for k in whole], dtype=np.int64)])
        place = (np.int64(table.column("bucket")[0].as_py() if rows else 0) << 32) | row
        settled = len(begin) + len(whole)
        spread = (place[len(keep) :].view(np.uint64) + np.arange(settled, dtype=np.uint64)) * np.uint64(_ODD)
        columns = {
            "key": pa.array(np.concatenate([h[keep], spread]).view(np.int64)),
            "doc": pa.array(np.concatenate([ids[keep], np.zeros(settled, dtype=np.int64)])),
            "place": pa.array(place),
            "span": pa.array((start << BITS) | n),
            "piece": pa.array([pieces[k] for k in keep] + [None] * settled, pa.binary()),
        }
        return pa.table(columns)

    return task


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of set flags that have one owner."""
    set_before = np.append(False, flags[:-1] & (owner[1:] == owner[:-1])) if len(flags) else flags
    begin = np.flatnonzero(flags & ~set_before)
    set_after = np.append(flags[1:] & (owner[1:] == owner[:-1]), False) if len(flags) else flags
    return begin, np.flatnonzero(flags & ~set_after) + 1


def _repeated(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of the suffixes at places of data is `length` bytes.

    More suffixes than SORTED are taken in parts, by a hash of those bytes: equal ones are in one part.
    """
    if len(at) <= SORTED:
        return longest_previous_factors(data[at[:, None] + np.arange(length)], doc, length) >= length
    h = _window_hashes(data, at, length)
    order = np.argsort(h)
    edges, out, a = np.append(np.flatnonzero(np.diff(h[order])) + 1, len(h)), np.zeros(len(h), dtype=bool), 0
    while a < len(h):
        # up to the last edge within SORTED, or the first one
        b = int(edges[max(np.searchsorted(edges, a + SORTED, side="right") - 1, np.searchsorted(edges, a, side="right"))])
        part = order[a:b]
        out[part] = longest_previous_factors(data[at[part][:, None] + np.arange(length)], doc[part], length) >= length
        a = b
    return out


def _previous_task(length: int):
    """PIECES sorted by key, piece and doc to what goes: (bucket, row, start, stop), in bytes of a text."""

    def judged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of table, first window, windows) of the runs of windows that an earlier document has."""
        key, doc = table.column("key").to_numpy(), table.column("doc").to_numpy()
        span, piece = table.column("span").to_numpy(), table.column("piece").chunk(0)
        n = span & _MASK
        same_key = key[1:] == key[:-1]
        new = np.append(True, ~(same_key & pc.equal(piece[1:], piece[:-1]).to_numpy(zero_copy_only=False)))
        head = np.flatnonzero(new)  # the first, of the least document, of equal pieces
        of = np.cumsum(new) - 1
        whole = np.flatnonzero(doc > doc[head][of])
        out = [(whole, np.zeros(len(whole), dtype=np.int64), n[whole])]

        # pieces whose key has others: the suffixes at their windows, in suffix order
        other = np.append(key[head][1:] == key[head][:-1], False)
        many = np.flatnonzero(other | np.append(False, other[:-1]))
        offsets, data = np.frombuffer(piece.buffers()[1], dtype=np.int32)[piece.offset :], np.frombuffer(piece.buffers()[2] or b"", dtype=np.uint8)
        rows = head[many]
        size = np.cumsum(n[rows])
        # the rows that have a piece whose document is the least, in the order of pieces
        least = np.flatnonzero(doc == doc[head][of])
        edges, a = np.append(np.flatnonzero(np.append(True, key[rows][1:] != key[rows][:-1])), len(rows)) if len(rows) else [], 0
        for k, b in enumerate(edges):
            last = b == len(rows)
            # as many whole keys as may be sorted at once
            if b <= a or not (last or size[edges[k + 1] - 1] - (size[a - 1] if a else 0) > SORTED):
                continue
            part = rows[a:b]
            windows = np.repeat(part, n[part])
            within = np.arange(len(windows)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            begin, stop = _runs(_repeated(data, offsets[windows] + within, doc[windows], length), windows)
            # the same for all rows of the piece's least document
            lo, hi = np.searchsorted(of[least], of[windows[begin]]), np.searchsorted(of[least], of[windows[begin]], side="right")
            each = np.repeat(np.arange(len(begin)), hi - lo)
            step = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            out.append((least[lo[each] + step], within[begin][each], (stop - begin)[each]))
            a = b
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            given = table.column("piece").is_valid()
            settled, open_ = table.filter(pc.invert(given)), table.filter(given).combine_chunks()
            parts = [(settled, np.arange(settled.num_rows), np.zeros(settled.num_rows, dtype=np.int64), settled.column("span").to_numpy() & _MASK)]
            if open_.num_rows:
                parts.append((open_, *judged(open_)))
            for rows, at, first, n in parts:
                place, start = rows.column("place").to_numpy()[at], (rows.column("span").to_numpy()[at] >> BITS) + first
                arrays = [pa.array((place >> 32).astype(np.int32)), pa.array((place & 0xFFFFFFFF).astype(np.int32)), pa.array(start), pa.array(start + n + length - 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "row", "start", "stop"])

    return task


def _covered(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, as maximal ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept_task(table: pa.Table, gone: pa.Table) -> pa.Table:
    """A bucket's texts and what goes of them, to their rows without it: doc_id, kept (bytes), spans (start and stop in turn)."""
    rows = _rows(table)
    doc, texts = [r[0] for r in rows], [r[1] for r in rows]
    row, start, stop = (gone.column(c).to_numpy() for c in ("row", "start", "stop"))
    order = np.argsort(row, kind="stable")
    row, start, stop = row[order], start[order], stop[order]
    edges = np.searchsorted(row, np.arange(len(doc) + 1))
    kept, spans = [], []
    for k, text in enumerate(texts):
        runs = _covered(start[edges[k] : edges[k + 1]], stop[edges[k] : edges[k + 1]])
        at, parts = 0, []
        for a, b in runs:
            parts.append(text[at:a])
            at = b
        kept.append(b"".join([*parts, text[at:]]))
        spans.append([x for run in runs for x in run])
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.int64()))})


def _digest_task(table: pa.Table, gone: pa.Table) -> pa.Table:
    out = _kept_task(table, gone)
    kept, spans = out.column("kept").to_pylist(), out.column("spans").to_pylist()
    removed = [n - len(k) for n, k in zip(out.column("n_bytes").to_pylist(), kept, strict=True)]
    digests = [hashlib.sha256(k).hexdigest() for k in kept]
    return pa.table({"doc_id": out.column("doc_id"), "n_bytes": out.column("n_bytes"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) // 2 for s in spans], pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def _cut(docs: DataFrame, length: int, hot: int, task, schema: str) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"a length of {GRAM} bytes at least")
    # rows without a doc_id, and those that share one, are dealt by their texts too
    size = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-size["docs"] // BUCKET), -(-size["bytes"] // BUCKET_BYTES))
    text = F.coalesce("text", F.lit(""))
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("own", F.xxhash64("doc_id", "text"))
    wide = wide.withColumn("bucket", F.pmod("own", F.lit(buckets)).cast("int"))
    dealt = mapped(wide.select("bucket", "own", "doc_id", F.col("text").cast("binary").alias("text")), _pack_task, "bucket int, own long, doc_id long, text binary")
    hashed = wide.where("doc_id IS NOT NULL").select("bucket", "own", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    first = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = written(hashed.join(first, ["h1", "h2"]).where("doc_id > first").select("bucket", "own"), "whole-copies")
    grams = dealt.groupBy("bucket").cogroup(copies.groupBy("bucket")).applyInArrow(_grams_task(length), "gram long, bucket int, n int, pieces int")
    shared = mapped(grams.repartition("gram").sortWithinPartitions("gram"), _shared_task(hot), "bucket int, value long, kind tinyint")
    marks = shared.union(copies.select("bucket", "own", F.lit(COPY).cast("tinyint")))
    pieces = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_pieces_task(length), PIECES)
    gone = mapped(pieces.repartition("key").sortWithinPartitions("key", "piece", "doc"), _previous_task(length), "bucket int, row int, start long, stop long")
    return dealt.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(task, schema)


def cut_repeats(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay) and spans (start and stop, in turn, of what goes) of every row of docs (doc_id, text).

    Texts are UTF-8 bytes, a null one is empty.  A byte goes that is covered by `length` bytes that also start in a document with
    a smaller doc_id; all is judged on the texts as given.  Rows that share a doc_id are one document: they take nothing
    from each other.  Rows without a doc_id stay whole and count for no other.  Other columns are not read.
    """
    return _cut(docs, length, hot, _kept_task, "doc_id long, n_bytes long, kept binary, spans array<long>")


def repeat_digests(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row of docs, as cut_repeats has them."""
    return _cut(docs, length, hot, _digest_task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
