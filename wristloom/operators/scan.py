"""What runs along the rows of a recording, spread over tasks: a filter's state, a Viterbi path, the last value known.

A recording's rows are dealt by (key, chunk); a chunk is a stretch of the order column.  A scan takes three steps:

1. Each chunk is summed up without knowing what was before it: how it turns any state at its start into one at its end.
2. The summaries of a recording, one row per chunk, are composed in order, which gives every chunk its starting state.
3. Each chunk runs over its rows from that state.

The rows are shuffled once: both passes over them read the same exchange.  A task never holds more of a recording than
a chunk (a filter: than a part of one, however dense the chunk), or a row for each of its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk that width_of aims at, and the width that makes every recording one chunk.
CHUNK_ROWS, ALL = 1 << 16, float(1 << 62)
CHUNK = "_chunk"

Summary = Callable[[pd.DataFrame], dict]


def position(df: DataFrame, order: str) -> Column:
    """The order column as a number: times as microseconds."""
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order)


def width_of(df: DataFrame, key: str, order: str, rows: int = CHUNK_ROWS) -> float:
    """A width of chunks, in units of position, that gives no recording more than about that many rows in each.

    One aggregation over the key and the order column.  If all recordings are shorter, the width is beyond all positions.
    """
    at = position(df, order).cast("double")
    span = df.groupBy(key).agg(F.count(at).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    least = span.where(F.col("n") > rows).agg(F.min((F.col("span") + 1) * rows / F.col("n"))).first()[0]
    return float(least) if least else ALL


def dealt(df: DataFrame, order: str, width: float, nulls_last: bool = False) -> DataFrame:
    """df with the number of each row's chunk; rows without an order are in the first, with nulls_last in one after all others."""
    if width >= ALL:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    return df.withColumn(CHUNK, F.coalesce(F.floor(position(df, order).cast("double") / F.lit(float(width))), F.lit((1 << 63) - 1 if nulls_last else -(1 << 62))).cast("long"))


def kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def starts(rows: DataFrame, key: str, summary: Summary, summary_schema: str, compose: Callable[[pd.DataFrame], list], start_schema: str) -> DataFrame:
    """(key, chunk, start): the state at the start of every chunk of rows, which dealt() made.

    summary gives a chunk's fields from its rows, in any order; compose gets a recording's summaries in order, and gives the start of each.
    """

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: pdf[key].iloc[0], CHUNK: pdf[CHUNK].iloc[0]} | summary(pdf)])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        return pd.DataFrame({key: pdf[key], CHUNK: pdf[CHUNK], "start": compose(pdf)})

    named = kinds(rows, key, CHUNK)
    ends = rows.groupBy(key, CHUNK).applyInPandas(sum_up, f"{named}, {summary_schema}")
    return ends.groupBy(key).applyInPandas(follow, f"{named}, start {start_schema}")


def onward(rows: DataFrame, begin: DataFrame, key: str, run: Callable[[pd.DataFrame, object], pd.DataFrame], schema: str) -> DataFrame:
    """run(rows of a chunk, its start) for every chunk of rows."""

    def one(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, start["start"].iloc[0])

    return rows.groupBy(key, CHUNK).cogroup(begin.groupBy(key, CHUNK)).applyInPandas(one, schema)


def numbers_of(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value of a column; -1 for null."""
    found = column.combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    return found.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def edges_of(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where each key of a sorted table begins, and the table's length."""
    begins = np.append(True, np.zeros(len(table) - 1, dtype=bool))
    for name in names:
        own = numbers_of(table.column(name))
        begins[1:] |= own[1:] != own[:-1]
    return np.append(np.flatnonzero(begins), len(table))


def whole_keys(batches: Iterator[pa.RecordBatch], key: str | list[str], rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, edges) of sorted batches: tables of some `rows` rows that hold all rows of their keys, and where each key begins.

    A key may be of several columns.
    """
    names = [key] if isinstance(key, str) else key
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held, size = [*held, batch] if batch.num_rows else held, size + batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            edges = edges_of(table, names)
            if len(edges) > 2:
                last = int(edges[-2])
                yield table.slice(0, last), edges[:-1]
                held, size = table.slice(last).to_batches(), len(table) - last
    if held:
        table = pa.Table.from_batches(held)
        yield table, edges_of(table, names)


def keys_in_parts(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """whole_keys() of keys of any length: one of more than some `rows` rows comes as several tables, each of it alone.

    The flag says that a table goes on with the key of the one before.
    """
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in chain(batches, [None]):
        if batch is not None:
            held, size = [*held, batch] if batch.num_rows else held, size + batch.num_rows
        if not size or batch is not None and size < rows:
            continue
        table = pa.Table.from_batches(held)
        edges = edges_of(table, names)
        if last is not None and len(edges_of(pa.concat_tables([last, table.slice(0, 1)]), names)) == 2:
            own = int(edges[1])
            yield table.slice(0, own), edges[:2], True
            table, edges = table.slice(own), edges[1:] - own
        if len(edges) > 2 or len(table) and batch is None:
            # all keys but the last one are whole; at the end that one is, too
            edges = edges if batch is None else edges[:-1]
            yield table.slice(0, int(edges[-1])), edges, False
            table = table.slice(int(edges[-1]))
        elif len(table) >= rows:
            yield table, edges, False
            last, table = table.slice(len(table) - 1), table.slice(len(table))
        held, size = table.to_batches(), len(table)


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    """A column's numbers; NaN for null."""
    return column.cast(pa.float64()).to_numpy()


def arrays(values: np.ndarray) -> pa.ListArray:
    """A column of arrays, the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), pa.float64()))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix of a column of arrays of that length."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.zeros(0), *parts]).reshape(-1, width)


# ---------------------------------------------------------------- last values


def carried(df: DataFrame, key: str, order: str, values: dict[str, Column], width: float, ahead: bool = False, ties: Column | None = None) -> DataFrame:
    """df with, for each name, the last non-null of a column up to each row (with ahead: the first one from it on).

    Window functions within chunks; what a chunk has none of comes from the nearest chunk that has, which is found among the
    chunks' own last values, a row per chunk.  Rows of equal order go by ties.
    """
    names = list(values)
    rows = dealt(df, order, width).withColumns({f"_own_{n}": v for n, v in values.items()})
    inner = Window.partitionBy(key, CHUNK).orderBy(F.col(order), *([ties] if ties is not None else []))
    inner = inner.rowsBetween(0, Window.unboundedFollowing) if ahead else inner.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if ahead else F.last
    rows = rows.withColumns({n: pick(f"_own_{n}", True).over(inner) for n in names})
    if width >= ALL:
        return rows.select(*df.columns, *names)
    at = position(df, order)
    ends = rows.groupBy(key, CHUNK).agg(*((F.min_by if ahead else F.max_by)(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), at)).alias(n) for n in names))
    over = Window.partitionBy(key).orderBy(CHUNK)
    over = over.rowsBetween(1, Window.unboundedFollowing) if ahead else over.rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select(F.col(key).alias("_key"), F.col(CHUNK).alias("_at"), *(pick(n, True).over(over).alias(f"_far_{n}") for n in names))
    joined = rows.join(beyond, F.col(key).eqNullSafe(F.col("_key")) & (F.col(CHUNK) == F.col("_at")))
    return joined.withColumns({n: F.coalesce(n, f"_far_{n}") for n in names}).select(*df.columns, *names)


def greatest_before(df: DataFrame, key: str, order: str, value: str, name: str, width: float) -> DataFrame:
    """df with name: the greatest value of the rows before each one, null for the first; the same way as carried()."""
    rows = dealt(df, order, width)
    inner = Window.partitionBy(key, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.max(value).over(inner))
    if width >= ALL:
        return rows.drop(CHUNK)
    over = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    beyond = rows.groupBy(key, CHUNK).agg(F.max(value).alias("_most")).select(F.col(key).alias("_key"), F.col(CHUNK).alias("_at"), F.max("_most").over(over).alias("_far"))
    joined = rows.join(beyond, F.col(key).eqNullSafe(F.col("_key")) & (F.col(CHUNK) == F.col("_at")))
    return joined.withColumn(name, F.greatest(name, "_far")).select(*df.columns, name)
