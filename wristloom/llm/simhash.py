"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has bit b where more than half of its shingles' hashes have it.  Documents
with the same fingerprint are one node from the start, so copies are never expanded.

Fingerprints within `radius` bits are found by multi-index hashing (Norouzi, Punjani and Fleet, 2012).
The 64 bits are split into segments.  If radius = q * segments + r, two such fingerprints differ in at
most q bits in one of the first r + 1 segments, or in at most q - 1 bits in one of the others; so each
fingerprint probes the small Hamming ball around each of its segments, and meets in the segment tables
every fingerprint that it can link to.  Of the two ends of a link it is enough that one probes: single
flips are made at zero bits only.

A segment alone is a coarse key: the fingerprints that share it by chance grow with the square of
their number.  Where d bits of a segment differ, at most radius - d of the other bits do, so if these are cut into
radius - d + 1 parts, one part is equal.  Tables are therefore keyed by a segment and one part of the
rest, some 26 to 28 bits with four segments, 30 with three.

Only components are asked for, so not every pair of a bucket is compared:

1. Every entry of a bucket is compared with the smallest fingerprint stored there.  The links found give
   first components; near copies, which crowd into buckets, are mostly joined here, in linear work.
2. Only entries of buckets that still hold more than one component are compared further, and only
   across components; in each bucket the component with most members stands on one side only.

Whatever link is left out joins two fingerprints that are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, slices, written
from .components import components

SEED = 42


def fingerprint(text: str, shingle: int = 4, seeds: tuple[int, ...] = (SEED,), at_once: int = 1 << 14) -> list[int]:
    """A 64-bit fingerprint of a text for each seed; 0 without words.  Memory is bounded by the text and at_once hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z, and exactly the six ASCII white-space characters
    if not words:
        return [0] * len(seeds)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed) for seed in seeds]
    n = len(words) - shingle + 1
    ones = np.zeros((len(seeds), 64), dtype=np.int64)
    for at in range(0, n, at_once):
        parts = [words[at + k : min(n, at + at_once) + k] for k in range(shingle)]
        grams = list(map(b" ".join, zip(*parts, strict=True)))
        for k, seed in enumerate(seeds):
            h = np.array([digest(s, seed) for s in grams], dtype="<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return [int((np.uint64(1) << np.flatnonzero(2 * c > n).astype(np.uint64)).sum(dtype=np.uint64)) for c in ones]


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit long) of docs (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            fp = np.array([fingerprint(t, shingle)[0] for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), task, "doc_id long, fp long")


def segments_of(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of that many segments of nearly the same width."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _rest(fp: Column, at: int, width: int) -> Column:
    """The bits of fp outside a segment, closed up."""
    low = fp.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
    high = F.shiftrightunsigned(fp, at + width) if at + width < 64 else F.lit(0).cast("long")
    return F.shiftleft(high, at).bitwiseOR(low)


def _buckets(fp: Column, radius: int, count: int) -> tuple[Column, Column]:
    """(array of buckets that fp is stored in, array of buckets that it probes besides); buckets are longs.

    A bucket is a kind (segment, flips and part), the segment's bits and the part's bits.
    """
    q, r = divmod(radius, count)
    stored, probes, kind = [], [], 0
    for k, (at, width) in enumerate(segments_of(count)):
        key = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        rest = _rest(fp, at, width)
        for d in range((q if k <= r else q - 1) + 1):
            n = radius - d + 1
            edges = [(64 - width) * p // n for p in range(n + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
                tail = F.shiftleft(part, width).bitwiseOR(F.lit(kind << 56))
                stored.append(tail.bitwiseOR(key))
                for flips in combinations(range(width), d) if d else ():
                    mask = sum(1 << x for x in flips)
                    probe = tail.bitwiseOR(key.bitwiseXOR(F.lit(mask)))
                    probes.append(F.when(key.bitwiseAND(F.lit(mask)) == 0, probe) if d == 1 else probe)
                kind += 1
    return F.array(*stored), F.array_compact(F.array(*probes)) if probes else F.array().cast("array<bigint>")


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def near_components(fps: DataFrame, radius: int = 4, segments: int = 4) -> DataFrame:
    """(fp, component) for distinct fingerprints fps (fp, node): the least node of those reachable.

    Exact for any number of segments.  Fewer segments make more probes and emptier buckets: 4 serve up to
    some tens of millions of fingerprints, 3 beyond.
    """
    known = written(fps.select("fp", "node"), "fingerprints")
    stored, probes = _buckets(F.col("fp"), radius, segments)
    entries = known.select("fp", F.explode(stored).alias("bucket"), F.lit(True).alias("stored")).union(known.select("fp", F.explode(probes).alias("bucket"), F.lit(False).alias("stored")))
    # a bucket matters if somebody else than its only member meets it
    heads = entries.groupBy("bucket").agg(F.min(F.when(F.col("stored"), F.col("fp"))).alias("head"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    # what comes of explode is many times what Spark takes it for, and sorted buckets are many times their files: never broadcast
    met = written(entries.hint("merge").join(heads.where("head IS NOT NULL AND low <> high").select("bucket", "head"), "bucket"), "buckets")
    linked = met.where((F.col("fp") != F.col("head")) & near(F.col("fp"), F.col("head"), radius))
    first = components(linked.select(F.col("fp").alias("a"), F.col("head").alias("b")))

    label = written(known.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("label")), "labels")
    members = met.hint("merge").join(label.select("fp", "label"), "fp").select("bucket", "fp", "label", "stored")
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    rest = written(members.join(mixed.select("bucket", "main"), "bucket"), "mixed-buckets")
    left = rest.where("label <> main").select("bucket", F.col("fp").alias("fp_a"), F.col("label").alias("a"), F.col("stored").alias("stored_a"))
    right = rest.select("bucket", F.col("fp").alias("fp_b"), F.col("label").alias("b"), F.col("stored").alias("stored_b"))
    across = left.hint("merge").join(right, [
        left.bucket == right.bucket, F.col("a") != F.col("b"), F.col("stored_a") | F.col("stored_b"), near(F.col("fp_a"), F.col("fp_b"), radius),
    ])
    second = components(across.select("a", "b"))
    joined = label.join(second.withColumnRenamed("node", "label"), "label", "left").select("fp", "node", F.coalesce("component", "label").alias("root"))
    joined = written(joined, "roots")
    least = joined.groupBy("root").agg(F.min("node").alias("component"))
    return joined.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, segments: int = 4) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that is reachable over links of at most `radius` differing bits,
    copies included.  Texts without words, null ones too, have fingerprint zero and are linked like any other.
    Rows with a null doc_id get a fingerprint, and the component of the others that share or neighbour it, or
    null; they link nothing.  Repeated rows give repeated results; other columns are not read.

    Words are lower-cased (A-Z) and cut at ASCII white space.  The default of five words and 4 of 64 bits is
    a cosine similarity of about 0.98 between documents' shingle counts.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    found = near_components(groups, radius, segments)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(found, "fp", "left").select("doc_id", hexed, F.col("component").alias("component_id"))


# ---------------------------------------------------------------- links by shingle similarity

#: A link is a Jaccard similarity of the sets of shingles of LINK[0] / LINK[1] or more.
LINK = (4, 5)
#: Segments of a sampled fingerprint, the bits of each, and the sampled shingles that vote in it.
SEGMENTS, SEGMENT_BITS, VOTERS = 64, 32, 5
#: Differing bits, of SEGMENTS * SEGMENT_BITS, up to which a pair is counted exactly.  Pairs at 0.8 differ in 321 on average,
#: with a standard deviation of 35; most pairs below 0.65 differ in more.
DISTANCE = 475
#: Entries of a bucket that are compared in one cell, and pairs of one document that are verified in one task.
CELL, PAIRS_AT_ONCE = 1024, 256


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none without words.  Words are those of fingerprint()."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    parts = [words[k : max(1, len(words) - shingle + 1) + k] for k in range(shingle)] if len(words) > shingle else [[w] for w in words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in zip(*parts, strict=True)], dtype=np.uint64))


def _odd(label: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{label}:{k}") | 1 for k in range(n)], dtype=np.uint64)


_SAMPLE, _VOTE = _odd("sample", SEGMENTS * VOTERS), _odd("vote", SEGMENTS * VOTERS)


def sampled_fingerprint(found: np.ndarray, at_once: int = 256) -> np.ndarray:
    """The segments of a shingle_set's fingerprint, as unsigned 32-bit words.

    A bit of a segment is what more than half of its VOTERS have there: hashes of those shingles that are least in as many
    orders of all shingles.  Texts with the same samples have the same segment.
    """
    least = np.full(SEGMENTS * VOTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), at_once):
        np.minimum(least, (_SAMPLE[:, None] * found[at : at + at_once]).min(axis=1), out=least)
    x = least * _VOTE
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    a, b, c, d, e = x.reshape(SEGMENTS, VOTERS).T
    one, two = a ^ b ^ c, (a & b) | (c & (a | b))  # a + b + c = one + 2 * two, bit by bit
    odd, more = one ^ d ^ e, (one & d) | (e & (one | d))
    return ((two & more) | ((two ^ more) & odd)).astype(np.uint32)


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    rows = np.ascontiguousarray(values)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints that _fixed made, as rows of segments."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), SEGMENTS)


def _apart(other: np.ndarray) -> np.ndarray:
    """The bits set in each row of segments."""
    return np.bitwise_count(other.view(np.uint64)).sum(axis=1)


def _alike(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    return np.minimum(size_a, size_b) * LINK[1] >= np.maximum(size_a, size_b) * LINK[0]


def _near_heads(pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b, with sizes and fingerprints) that may be linked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            a, b, size_a, size_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            ok = _alike(size_a, size_b) & (_apart(_words(batch.column(4)) ^ _words(batch.column(5))) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return mapped(pairs.select("a", "b", "a_size", "b_size", "a_fp", "b_fp"), task, "a long, b long")


@dataclass
class _Cell:
    """Rows of a bucket that are compared: those of two blocks across them, those of one block with each other."""

    segment: int
    block: np.ndarray
    node: np.ndarray
    label: np.ndarray
    size: np.ndarray
    fp: np.ndarray

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those rows after i, of others, that may be linked with it; a pair meets in the first segment it has in common only."""
        ok = (self.label[others] != self.label[i]) & _alike(self.size[i], self.size[others])
        if self.block[0] != self.block[-1]:
            ok &= self.block[others] != self.block[i]
        others = others[ok]
        other = self.fp[i] ^ self.fp[others]
        return others[(_apart(other) <= DISTANCE) & ((other == 0).argmax(axis=1) == self.segment)]

    def with_company(self) -> np.ndarray:
        """The rows that are near another."""
        known = np.zeros(len(self.node), dtype=bool)
        for i in range(len(known) - 1):
            # a pair of rows that are known to be near others says nothing new
            after = np.arange(i + 1, len(known))
            found = self.near(i, after[~known[after]] if known[i] else after)
            known[found] = True
            known[i] |= len(found) > 0
        return np.flatnonzero(known)

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """A spanning forest of the links among the rows."""
        root, out = np.arange(len(self.node)), []
        for i in range(len(root) - 1):
            after = np.arange(i + 1, len(root))
            for j in self.near(i, after[root[after] != root[i]]):
                if root[i] != root[j]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common * LINK[1] >= (len(sets[i]) + len(sets[j]) - common) * LINK[0]:
                        out.append((i, int(j)))
                        root[root == root[j]] = root[i]
        return out


def _in_cells(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(_Cell, its rows as an Arrow batch) for each cell of rows (bucket, cell, block, node, label, size, fp, ...).

    Rows are sorted by bucket and cell; a cell's rows, and no others, are held together.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            bucket, cell, *columns = (batch.column(k).to_numpy() for k in range(6))
            edges = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1), len(bucket)]
            fp = _words(batch.column(6))
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    yield from work(_Cell(int(bucket[a]) % SEGMENTS, *(x[a:b] for x in columns), fp[a:b]), batch.slice(a, b - a))

        for batch in batches:
            bucket, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(bucket):
                continue
            if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (bucket[0], cell[0]):
                yield from found(held)
                held = []
            # rows of the last cell wait for the next batch
            last = int(np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1])).max(initial=-1)) + 1
            if last:
                yield from found([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(held)

    sorted_rows = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "block")
    return mapped(sorted_rows, task, schema)


_PLACE = ("bucket", "cell", "block", "node", "label", "size", "fp")


def _with_company(rows: DataFrame) -> DataFrame:
    """(bucket, cell, block, node) of those rows of cells that are near another of their cell."""

    def work(cell: _Cell, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = cell.with_company()
        if len(at):
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(at)) for k in range(4)], list(_PLACE[:4]))

    return _in_cells(rows.select(*_PLACE), work, "bucket long, cell long, block long, node long")


def _links_in_cells(rows: DataFrame) -> DataFrame:
    """(a, b): labels of rows, with their sets, that links of their cells join."""

    def work(cell: _Cell, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [x.values.to_numpy() for x in batch.column(7)]
        pairs = cell.links(sets)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(cell.label[[p[k] for p in pairs]]) for k in (0, 1)], ["a", "b"])

    return _in_cells(rows.select(*_PLACE, "set"), work, "a long, b long")


def _cells(rows: DataFrame) -> DataFrame:
    """rows (bucket, size_of_bucket, node, ...) in cells of about CELL rows at most: a large bucket's rows are dealt into
    blocks, and every two blocks are a cell."""
    blocks = F.when(F.col("size_of_bucket") <= CELL, F.lit(1)).otherwise(F.ceil(F.col("size_of_bucket") * 2 / CELL)).cast("long")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))


def _with_sets(pairs: DataFrame, sets: DataFrame, x: str) -> DataFrame:
    """pairs with the set of column x as {x}_set; a node of many pairs is dealt out over many tasks."""
    other = "b" if x == "a" else "a"
    parts = pairs.groupBy(x).agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).cast("long").alias("_parts"))
    dealt = pairs.join(parts, x).withColumn("_part", F.pmod(F.xxhash64(other), "_parts")).drop("_parts")
    copies = sets.join(parts.withColumnRenamed(x, "node"), "node").select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    return dealt.join(copies, [x, "_part"]).drop("_part")


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets (node, set) have a similarity of LINK or more, counted exactly."""
    both = _with_sets(_with_sets(pairs.select("a", "b"), sets, "a"), sets, "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return both.where(common * LINK[1] >= union * LINK[0]).select("a", "b")


def similar_components(known: DataFrame, sets_of) -> DataFrame:
    """(node, component) of known (node, size, fp), distinct shingle sets: links of LINK and more.

    Segment k of a fingerprint is looked up in table k; the entries of a bucket have the segment in common.  They are compared in
    cells by their complete fingerprints, and those that are near another get their sets, by which links are counted exactly.  A
    cell gives no more links than it has rows.  In buckets of more than CELL entries each entry is first held against the least
    and the greatest node, in linear work: near copies, which crowd there, become one label, and a bucket of one label is done.
    sets_of(nodes) gives (node, set).
    """
    traits = known.drop("buckets")
    entries = known.select("node", F.explode("buckets").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size_of_bucket")).where("low <> high")
    met = written(entries.hint("merge").join(heads, "bucket"), "similar-buckets")  # as in near_components
    label = traits.withColumn("label", F.col("node"))
    large = met.where(F.col("size_of_bucket") > CELL)
    crowded = not large.isEmpty()
    if crowded:
        label = written(_labelled(large, traits, sets_of), "similar-labels")
        members = large.select("bucket", "node").hint("merge").join(label.select("node", "label"), "node")
        done = members.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least = most").select("bucket")
        met = met.join(done, "bucket", "left_anti")
    rows = _cells(met.select("bucket", "size_of_bucket", "node").hint("merge").join(label, "node"))
    wanted = written(_with_company(rows), "similar-wanted")
    sets = sets_of(wanted.select("node").distinct())
    found = _links_in_cells(wanted.join(label.join(sets, "node"), "node"))
    second = components(found)
    joined = label.select("node", "label").join(second.withColumnRenamed("node", "label"), "label", "left")
    return joined.select("node", F.coalesce("component", "label").alias("component"))


def _labelled(large: DataFrame, traits: DataFrame, sets_of) -> DataFrame:
    """traits and a label: the component by links with the least and the greatest nodes of large buckets."""

    def named(x: str) -> DataFrame:
        return traits.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("fp").alias(f"{x}_fp"))

    pairs = [large.where(F.col("node") != F.col(end)).select(F.least("node", end).alias("a"), F.greatest("node", end).alias("b")) for end in ("low", "high")]
    pairs = pairs[0].union(pairs[1]).distinct().join(named("a"), "a").join(named("b"), "b")
    near = written(_near_heads(pairs), "similar-heads")
    sets = written(sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "similar-sets")
    first = components(linked_pairs(near, sets))
    return traits.join(first, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def similar_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and component_id of every row of docs, as near_duplicates has them, with links by shingle similarity.

    Two rows are linked if the Jaccard similarity of their sets of shingles is LINK or more.  A plain fingerprint differs in 15 %
    of its bits at 0.8, and no small ball of a selective segment holds that, so segments take their votes from samples: at 0.8 one
    segment is equal with a chance of 0.33, and none of 64 with one of 9e-12.  Every link is counted exactly.

    Rows without words, null ones too, are copies of each other.  Rows with a null doc_id take the component of
    their copies, or null, and link nothing.  Repeated rows give repeated results; no rows give none; other columns are not read.
    """

    def keyed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        sets = [shingle_set(t, shingle) for t in texts]
        both = [(h >> 64, h & (1 << 64) - 1) for h in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)]
        return sets, np.array(both, dtype=np.uint64).reshape(-1, 2).view(np.int64)

    def lists(values: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            sets, keys = keyed(batch.column(1).to_pylist())
            fp = np.array([sampled_fingerprint(s) for s in sets], dtype=np.uint32).reshape(-1, SEGMENTS)
            # a bucket is a segment and its table's number
            buckets = fp.astype(np.uint64) * np.uint64(SEGMENTS) + np.arange(SEGMENTS, dtype=np.uint64)
            columns = [batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(list(buckets)), pa.array(np.array([len(s) for s in sets], dtype=np.int64)), _fixed(fp)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hi", "lo", "buckets", "size", "fp"])

    def set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, keys = keyed(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(sets)], ["hi", "lo", "set"])

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    prints = written(mapped(source, task, "doc_id long, hi long, lo long, buckets array<long>, size long, fp binary"), "similar-prints")
    # rows of one doc_id may have several sets: a node is a hash of its own
    traits = ("buckets", "size", "fp")
    groups = prints.where("doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in traits))
    groups = written(groups.withColumn("node", F.xxhash64("hi", "lo")), "similar-groups")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = written(groups.select("node", "hi", "lo", "least").join(nodes, "node"), "similar-nodes")
        texts = source.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
        sets = mapped(texts, set_task, "hi long, lo long, set array<long>").join(wanted.select("node", "hi", "lo"), ["hi", "lo"])
        return sets.groupBy("node").agg(F.first("set").alias("set"))

    found = similar_components(groups.select("node", *traits), sets_of).join(groups.select("node", "hi", "lo", "least"), "node")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = written(found.join(least, "component").select("hi", "lo", "component_id"), "similar-found")
    return prints.select("doc_id", "hi", "lo").join(found, ["hi", "lo"], "left").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near copies of a document with a smaller doc_id, as similar_duplicates finds them.

    Of rows that share a doc_id, all stay or go; rows with a null doc_id stay.  The columns are those of docs.
    """
    found = similar_duplicates(docs.select("doc_id", "text"), **how)
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("_llm_first")).where("doc_id <> _llm_first")
    gone = written(gone.select(F.col("doc_id").alias("_llm_gone")), "near-copies")
    return docs.join(gone, F.col("doc_id") == F.col("_llm_gone"), "left_anti")
