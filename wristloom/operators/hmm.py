"""A hidden Markov model over predicted labels: fitted by counting, decoded by Viterbi.

A recording is decoded in chunks.  Scores along a chunk are a matrix, the best from each state before it to each
state at its end, and matrices of following chunks multiply with maximum for sum and sum for product.  That gives the
scores before every chunk, from which it finds where each of its last states came from; those pointers, followed from the
last chunk back, give every chunk's last state, and each chunk its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

TINY = 1e-16


@dataclass
class Hmm:
    labels: list[str]
    prior: list[float]
    emission: list[list[float]]  # true label x observed label
    transition: list[list[float]]
    #: If set, logarithms are rounded to multiples of it, best a power of 2: sums are then exact, so equal paths are equal to the bit however rows are cut.
    grid: float | None = None

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of prior, emission and transition."""
        out = tuple(np.log(np.asarray(x, dtype=float) + TINY) for x in (self.prior, self.emission, self.transition))
        return tuple(np.round(x / self.grid) * self.grid for x in out) if self.grid else out


def emission(df: DataFrame, true: str, probabilities: list[str]) -> DataFrame:
    """Per true label, the mean of each class probability."""
    return df.groupBy(true).agg(*(F.avg(c).alias(c) for c in probabilities))


def transitions(df: DataFrame, key: str | None, order: str, label: str) -> DataFrame:
    """(from, to, n, p): how often a label follows another in the order of a key's rows, and its share of from's.

    Without a key, rows are one series, and transitions cross recordings: rows are then dealt by stretches of the order column,
    and the last label of one is followed by the first of the next.
    """
    if key:
        by = Window.partitionBy(key).orderBy(order)
        steps = df.select(F.col(label).alias("from"), F.lead(label).over(by).alias("to"))
    else:
        one = df.select(F.lit(0).alias("_key"), order, label)
        rows = scan.dealt(one, order, scan.width_of(one, "_key", order))
        inside = rows.select(F.col(label).alias("from"), F.lead(label).over(Window.partitionBy(scan.CHUNK).orderBy(order)).alias("to"))
        ends = rows.groupBy(scan.CHUNK).agg(F.min_by(F.struct(label), order).alias("first"), F.max_by(F.struct(label), order).alias("last"))
        across = ends.select(F.col(f"last.{label}").alias("from"), F.lead(f"first.{label}").over(Window.orderBy(scan.CHUNK)).alias("to"))
        steps = inside.union(across)
    steps = steps.where("to IS NOT NULL AND from IS NOT NULL")
    counts = steps.groupBy("from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def fit(df: DataFrame, key: str | None, order: str, true: str, probabilities: dict[str, str], uniform_prior: bool = True) -> Hmm:
    """probabilities: label -> column of its predicted probability.  Tables of labels squared come to the driver."""
    labels = sorted(probabilities)
    at = {x: k for k, x in enumerate(labels)}
    e = np.zeros((len(labels), len(labels)))
    for row in emission(df, true, [probabilities[x] for x in labels]).collect():
        if row[true] in at:
            e[at[row[true]]] = [row[probabilities[x]] or 0.0 for x in labels]
    t = np.zeros_like(e)
    for row in transitions(df, key, order, true).collect():
        if row["from"] in at and row["to"] in at:
            t[at[row["from"]], at[row["to"]]] = row["p"]
    if uniform_prior:
        prior = np.full(len(labels), 1 / len(labels))
    else:
        counts = {r[true]: r["n"] for r in df.groupBy(true).agg(F.count("*").alias("n")).collect()}
        prior = np.array([counts.get(x, 0) for x in labels], dtype=float)
        prior /= prior.sum()
    return Hmm(labels, prior.tolist(), e.tolist(), t.tolist())


def _forward(observed: np.ndarray, hmm: Hmm, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(scores after the last row, pointers): before holds the scores of states before the first row, or None at a recording's start.

    before may have leading axes, for several starts at once.  Of equal scores the first state is pointed to.
    """
    prior, e, t = hmm.logs()
    lead = before.shape[:-1] if before is not None else ()
    back = np.zeros((len(observed), *lead, len(hmm.labels)), dtype=np.int32)
    best = before
    for k, o in enumerate(observed):
        if best is None:
            best = prior + e[:, o]
            continue
        through = best[..., :, None] + t
        back[k] = through.argmax(axis=-2)
        best = through.max(axis=-2) + e[:, o]
    return best, back


def _path(back: np.ndarray, last: int) -> np.ndarray:
    """The states that pointers lead to from the last one."""
    path = np.zeros(len(back), dtype=int)
    for k in range(len(back) - 1, -1, -1):
        path[k] = last
        last = back[k, last]
    return path


def decode(observed: np.ndarray, hmm: Hmm) -> np.ndarray:
    """The likeliest states of a series of observed label numbers; the first of equals wins."""
    if not len(observed):
        return np.zeros(0, dtype=int)
    best, back = _forward(observed, hmm, None)
    return _path(back, int(best.argmax()))


#: Rows times states of recordings that are decoded side by side.
CELLS = 1 << 22


def decode_many(series: list[np.ndarray], hmm: Hmm) -> list[np.ndarray]:
    """decode() of many series, row by row of all of them at once: the same sums in the same order, so the same paths."""
    prior, e, t = hmm.logs()
    states, out = len(hmm.labels), [np.zeros(0, dtype=int)] * len(series)
    order, at = sorted((k for k, s in enumerate(series) if len(s)), key=lambda k: -len(series[k])), 0
    while at < len(order):
        longest = len(series[order[at]])
        part = order[at : at + max(1, CELLS // (longest * states))]
        at += len(part)
        lengths = np.array([len(series[k]) for k in part])
        seen = np.zeros((longest, len(part)), dtype=np.int64)
        for j, k in enumerate(part):
            seen[: lengths[j], j] = series[k]
        back = np.zeros((longest, len(part), states), dtype=np.int32)
        best = prior + e[:, seen[0]].T
        for k in range(1, longest):
            live = int(np.searchsorted(-lengths, -k))  # longer than k: the first ones
            through = best[:live, :, None] + t
            back[k, :live] = through.argmax(axis=1)
            best[:live] = through.max(axis=1) + e[:, seen[k, :live]].T
        path, now = np.zeros((longest, len(part)), dtype=int), best.argmax(axis=1)
        column = np.arange(len(part))
        for k in range(longest - 1, -1, -1):
            inside = lengths > k
            path[k, inside] = now[inside]
            now = np.where(inside, back[k, column, now], now)
        for j, k in enumerate(part):
            out[k] = path[: lengths[j], j]
    return out


def _smooth_whole(df: DataFrame, key: str, order: str, label: str, hmm: Hmm) -> DataFrame:
    """smooth() of recordings that are one chunk each: a task decodes many of them side by side."""
    labels = pa.array(hmm.labels, pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in scan.whole_keys(batches, key):
            codes = pc.index_in(table.column(label).combine_chunks(), value_set=labels).fill_null(-1)
            codes = np.asarray(codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes)
            known = codes >= 0
            series = [codes[a:b][known[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
            found = np.full(len(codes), -1, dtype=np.int64)
            found[known] = np.concatenate([np.zeros(0, dtype=np.int64), *decode_many(series, hmm)])
            smoothed = labels.take(pa.array(found, mask=found < 0))
            yield from table.append_column("smoothed", smoothed).combine_chunks().to_batches()

    rows = df.repartition(key).sortWithinPartitions(key, order, label)
    return rows.mapInArrow(task, f"{scan.kinds(df, *df.columns)}, smoothed string")


def _identity(n: int) -> np.ndarray:
    return np.where(np.eye(n, dtype=bool), 0.0, -np.inf)


def scores_before(chunks: pd.DataFrame, states: int) -> list[np.ndarray | None]:
    """The scores before chunks (n, first, matrix) in order; None before the first that has observed rows.

    first holds the scores after a chunk that begins a recording, matrix those after it from each state before it.
    """
    now, out = None, []
    for n, first, matrix in zip(chunks["n"], chunks["first"], chunks["matrix"], strict=True):
        out.append(now)
        if n:
            now = np.asarray(first) if now is None else (now[:, None] + np.asarray(matrix).reshape(states, states)).max(axis=0)
    return out


def smooth(df: DataFrame, key: str, order: str, label: str, hmm: Hmm, width: float | None = None) -> DataFrame:
    """Adds smoothed: the Viterbi path of each recording's labels; null and unknown labels stay null and are passed over.

    width is that of a chunk in units of the order column (microseconds of times); by default what scan.width_of finds, so
    that recordings of up to scan.CHUNK_ROWS rows are decoded by one task.  Chunks add the same logarithms in another order than
    a single run does, so where paths are equal but for rounding, another may be taken; with hmm.grid set they never differ.
    Rows of equal order go by label.
    """
    at, states = {x: k for k, x in enumerate(hmm.labels)}, len(hmm.labels)
    names = np.array(hmm.labels, dtype=object)
    fields, columns = scan.kinds(df, *df.columns), df.columns

    def observed(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values([order, label], kind="stable")
        known = pdf[label].isin(at).to_numpy()
        return pdf, known, pdf[label].to_numpy()[known]

    def numbers(labels: np.ndarray) -> np.ndarray:
        return np.array([at[x] for x in labels], dtype=int)

    def labelled(pdf: pd.DataFrame, known: np.ndarray, path: np.ndarray) -> pd.DataFrame:
        out = np.full(len(pdf), None, dtype=object)
        out[known] = names[path]
        return pdf[columns].assign(smoothed=out)

    width = width or scan.width_of(df, key, order)
    if width >= scan.ALL:
        # no recording has more than a chunk: nothing is before or after it
        return _smooth_whole(df, key, order, label, hmm)
    rows = scan.dealt(df, order, width)

    def summary(pdf: pd.DataFrame) -> dict:
        seen = numbers(observed(pdf)[2])
        if not len(seen):
            return {"n": 0, "first": [], "matrix": []}
        return {"n": len(seen), "first": _forward(seen, hmm, None)[0].tolist(), "matrix": _forward(seen, hmm, _identity(states))[0].reshape(-1).tolist()}

    def before(chunks: pd.DataFrame) -> list:
        return scores_before(chunks, states)

    scores = scan.starts(rows, key, summary, "n long, first array<double>, matrix array<double>", before, "array<double>")

    def came_from(pdf: pd.DataFrame, start) -> pd.DataFrame:
        """For each state at a chunk's end: its score, and the state before the chunk that its path comes from (-1 at a recording's start)."""
        seen = numbers(observed(pdf)[2])
        best, back = _forward(seen, hmm, None if start is None else np.asarray(start, dtype=float))
        source = [int(back[0, _path(back, j)[0]]) if start is not None else -1 for j in range(states)] if len(seen) else []
        return pd.DataFrame([{key: pdf[key].iloc[0], scan.CHUNK: pdf[scan.CHUNK].iloc[0], "scores": [] if best is None or not len(seen) else best.tolist(), "source": source}])

    named = scan.kinds(rows, key, scan.CHUNK)
    pointers = scan.onward(rows, scores, key, came_from, f"{named}, scores array<double>, source array<int>")

    def backward(chunks: pd.DataFrame) -> pd.DataFrame:
        """The state at every chunk's end, from the last chunk back."""
        chunks = chunks.sort_values(scan.CHUNK)
        last, out = None, []
        for scores_, source in zip(chunks["scores"].iloc[::-1], chunks["source"].iloc[::-1], strict=True):
            if len(source) and last is None:
                last = int(np.argmax(scores_))
            out.append(-1 if last is None else last)
            if len(source):
                last = int(source[last])
        return chunks[[key, scan.CHUNK]].assign(last=np.array(out[::-1], dtype=np.int32))

    ends = pointers.groupBy(key).applyInPandas(backward, f"{named}, last int")
    # scores before a chunk, none at a recording's start, and its last state after them
    both = F.array_append(F.coalesce(scores["start"], F.array().cast("array<double>")), ends["last"].cast("double"))
    given = scores.join(ends, [scores[key].eqNullSafe(ends[key]), scores[scan.CHUNK] == ends[scan.CHUNK]]).select(scores[key], scores[scan.CHUNK], both.alias("start"))

    def run(pdf: pd.DataFrame, given: np.ndarray) -> pd.DataFrame:
        pdf, known, seen = observed(pdf)
        if not len(seen):
            return labelled(pdf, known, np.zeros(0, dtype=int))
        _, back = _forward(numbers(seen), hmm, np.asarray(given[:-1], dtype=float) if len(given) > 1 else None)
        return labelled(pdf, known, _path(back, int(given[-1])))

    return scan.onward(rows, given, key, run, f"{fields}, smoothed string")
