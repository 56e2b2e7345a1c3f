"""Ranked lexical search by the Best Position Algorithm (Akbarinia, Pacitti and Valduriez, 2007).

Documents are scored against queries by integer impacts, a BM25 of whole numbers.  Texts are read once for every block
of queries and leave postings of the block's terms only.  Postings are searched where they lie: a task takes them in
segments, sorts each term's by impact, and runs the algorithm for each query.

The algorithm reads a query's lists from the top in step, and looks each new document up in all of the lists (direct
access), which gives its whole score and its position in each list.  A list's best position is the end of the positions
seen without a gap, however they were seen; no unseen document has more than the sum of the impacts there.  A
query is done when that sum is strictly below its k-th score, so ties are never cut.  The k-th score is carried from
segment to segment of a task, and tasks' results are merged by a window.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, mapped, slices, written

#: Terms are maximal matches of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`, here of UTF-8 bytes.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Queries, and bytes of their texts, of a block: what the tasks get of the queries is bounded by these.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 1000, 1 << 23
#: Documents of a segment, cells (terms of a query by documents) of the tables for direct access that a segment must do with, positions read from each list in a query's first step (each step doubles them), and bytes of a text cut at once.
SEGMENT, CELLS, STEP, TEXT_AT_ONCE = 16_384, 1 << 22, 16, 1 << 20


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z in lower case, in lists of bounded size (but for a single longer term)."""
    raw, at = (text or "").encode().lower(), 0
    while at < len(raw):
        end = at + TEXT_AT_ONCE
        if cut := TERM.match(raw, end):
            end = cut.end()
        yield TERM.findall(raw, at, end)
        at = end


@dataclass
class Queries:
    """A block of queries: their ids, the numbers and repeats of their terms, and the number of each term."""

    ids: list = field(default_factory=list)
    terms: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)

    def add(self, item_id, text: str | None) -> None:
        count: Counter[bytes] = Counter()
        for part in terms(text):
            count.update(part)
        self.ids.append(item_id)
        self.terms.append((np.array([self.number.setdefault(t, len(self.number)) for t in count], dtype=np.int64), np.array(list(count.values()), dtype=np.int64)))


def blocks(items: Iterable[Row]) -> Iterator[Queries]:
    """Rows (item_id, text) in blocks."""
    block, held = Queries(), 0
    for row in items:
        more = len((row["text"] or "").encode())
        if block.ids and (len(block.ids) >= ITEMS_AT_ONCE or held + more > BYTES_AT_ONCE):
            yield block
            block, held = Queries(), 0
        block.add(row["item_id"], row["text"])
        held += more
    if block.ids:
        yield block


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document) and arrays term, tf of those terms that have a number; documents without terms go."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, found = [], []
            for text in batch.column(1).to_pylist():
                count: Counter[bytes] = Counter()
                size = 0
                for part in terms(text):
                    size += len(part)
                    count.update(filter(number.__contains__, part))
                n.append(size)
                found.append(count)
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            term = pa.array(np.array([number[t] for c in found for t in c], dtype=np.int32))
            tf = pa.array(np.array([k for c in found for k in c.values()], dtype=np.int64))
            size = np.array(n, dtype=np.int64)
            arrays = [batch.column(0), pa.array(size), pa.ListArray.from_arrays(ends, term), pa.ListArray.from_arrays(ends, tf)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "term", "tf"]).filter(pa.array(size > 0))

    source = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return mapped(source, task, "doc_id long, n long, term array<int>, tf array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term adds to its document's score, for each posting: n terms in the document, tf of them this one."""
    m = 25 + (75 * n * documents) // all_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Segment:
    """Impact lists of some documents: for each term its documents by falling impact."""

    def __init__(self, doc_id: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc_id, self.doc, self.impact = doc_id, doc[order], impact[order]
        self.ends = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, term: np.ndarray, repeats: np.ndarray, k: int, kth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, score) of the documents that may be among the k best: all of score kth or more of those seen.

        kth is a score that k documents elsewhere have reached, or 0.
        """
        lists = [(a, b, r) for a, b, r in zip(self.ends[term], self.ends[term + 1], repeats, strict=True) if b > a and self.impact[a] > 0]
        if not lists:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        docs = [self.doc[a:b] for a, b, _ in lists]
        score = [self.impact[a:b] * r for a, b, r in lists]
        size = np.array([len(d) for d in docs])
        # direct access: a document's impact and position in each list; one past a list's end where it is not in it
        by_doc = np.zeros((len(lists), len(self.doc_id)), dtype=np.int64)
        place = np.repeat(size[:, None], len(self.doc_id), axis=1)
        for k_, (d, s) in enumerate(zip(docs, score, strict=True)):
            by_doc[k_, d] = s
            place[k_, d] = np.arange(len(d))
        seen_doc = np.zeros(len(self.doc_id), dtype=bool)
        seen_place = [np.zeros(n + 1, dtype=bool) for n in size]
        best = np.zeros(len(lists), dtype=np.int64)  # positions seen without a gap
        found, scores, at, step = [], [], 0, STEP
        while True:
            read = np.unique(np.concatenate([d[at : at + step] for d in docs]))
            new = read[~seen_doc[read]]
            seen_doc[new] = True
            found.append(new)
            scores.append(by_doc[:, new].sum(axis=0))
            limit = 0
            for j, seen in enumerate(seen_place):
                seen[place[j, new]] = True
                seen[size[j]] = False  # a stop, so that the search for a gap ends
                best[j] += int(np.argmin(seen[best[j] :]))
                # all of a list seen: what is unseen is not in it
                limit += int(score[j][max(best[j] - 1, 0)]) if best[j] < size[j] else 0
            known = np.concatenate(scores)
            if len(known) >= k:
                kth = max(kth, int(np.partition(known, len(known) - k)[len(known) - k]))
            at, step = at + step, step * 2
            if limit < kth or limit == 0 or at >= size.max():
                keep = (known >= kth) & (known > 0)
                return self.doc_id[np.concatenate(found)[keep]], known[keep]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two (doc_id, score): by falling score, then by doc_id."""
    doc, score = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((doc, -score))[:k]
    return doc[order], score[order]


def _search(held: DataFrame, queries: Queries, weights: np.ndarray, documents: int, all_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents for each query."""

    segment = max(1, min(SEGMENT, CELLS // max(1, *(len(t) for t, _ in queries.terms), 1)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in queries.ids]

        def search(parts: list[pa.RecordBatch]) -> None:
            batch = pa.Table.from_batches(parts).combine_chunks()
            doc_id, n = (batch.column(c).to_numpy() for c in (0, 1))
            size = np.concatenate([p.column(2).value_lengths().to_numpy() for p in parts])
            term, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in (2, 3))
            doc = np.repeat(np.arange(len(doc_id)), size)
            lists = Segment(doc_id, doc, term, impacts(weights[term], tf, n[doc], documents, all_terms), len(weights))
            for i, (t, repeats) in enumerate(queries.terms):
                kth = int(top[i][1][-1]) if len(top[i][1]) == k else 0
                top[i] = _merged(top[i], lists.best(t, repeats, k, kth), k)

        parts, rows = [], 0
        for batch in slices(batches, segment):
            parts, rows = [*parts, batch], rows + batch.num_rows
            if rows >= segment:
                search(parts)
                parts, rows = [], 0
        if rows:
            search(parts)
        item = np.repeat(np.arange(len(top)), [len(d) for d, _ in top]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate([t[c] for t in top])) for c in (0, 1))], ["item", "doc_id", "score"])

    return mapped(held, task, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k best documents of docs (doc_id, text) for each row of items (item_id, text).

    Documents of equal scores come by doc_id; those of score 0 never.  Rows without doc_id, a text or a term in it count for
    nothing; rows that share a doc_id are documents of their own, as are repeated items.  Items without a
    term that a document has give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    for queries in blocks(items.select("item_id", "text").toLocalIterator()):
        held = written(postings(docs, queries.number), "postings")
        total = held.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not total["documents"]:
            break
        # a row for each term of the block at most
        df = held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        weights = np.zeros(len(queries.number), dtype=np.int64)
        for row in df:
            weights[row["term"]] = weight(total["documents"], row["df"])
        ranked = _search(held, queries, weights, total["documents"], total["terms"], k).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"item int, item_id {id_type}")
        result = result.union(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result


def search_sql(k: int = 10) -> str:
    """The same in DuckDB SQL: every document is scored."""
    cut = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, unnest({cut}) AS t FROM documents),
    postings AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
    sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
    q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({cut}) AS t FROM benchmark) GROUP BY ALL),
    weights AS (
      SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM postings, total WHERE t IN (SELECT t FROM q) GROUP BY t),
    scored AS (
      SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN weights USING (t) JOIN postings USING (t) JOIN sizes USING (doc_id), total GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
