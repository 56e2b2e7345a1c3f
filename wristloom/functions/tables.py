"""Table functions for SQL: SELECT * FROM epochs(TABLE(samples), 'id', 't', 'value', 30)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Epochs:
    """epochs(TABLE, key, time, value, period [, least]): the rows of operators.epochs.epoch_statistics.

    The table is partitioned by key and ordered by time, which the function itself asks for.  State is one open epoch: counts
    and running moments, so a partition of any length takes no memory.  Rows without a time are passed over.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, value: AnalyzeArgument, period: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or not all(isinstance(a.value, str) for a in (key, time, value)):
            raise ValueError("epochs(TABLE, key, time, value, period): the names of three columns, as constant strings")
        fields = {f.name: f.dataType for f in table.dataType.fields}
        for a in (key, time, value):
            if a.value not in fields:
                raise ValueError(f"no column {a.value} in {sorted(fields)}")
        numbers = [T.StructField(n, T.DoubleType()) for n in ("mean", "low", "high", "range", "std", "std_r")]
        schema = T.StructType([T.StructField(key.value, fields[key.value]), T.StructField("epoch", T.LongType()), T.StructField("epoch_start", fields[time.value]), T.StructField("n", T.LongType()), *numbers])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(time.value)])

    def __init__(self) -> None:
        self.first: datetime | None = None
        self.epoch = -1
        self._clear()

    def _clear(self) -> None:
        self.n, self.mean, self.square, self.low, self.high = 0, 0.0, 0.0, math.inf, -math.inf

    def eval(self, row, key: str, time: str, value: str, period: float, least: int = 0) -> Iterator[tuple]:
        at = row[time]
        if at is None:
            return
        self.key, self.step, self.least = row[key], timedelta(seconds=float(period)), least
        if self.first is None:
            self.first = at
        number = (at - self.first) // self.step
        if number != self.epoch:
            yield from self._closed()
            self.epoch = number
        v = row[value]
        if v is not None:
            # running moments (Welford, 1962)
            v = float(v)
            self.n += 1
            off = v - self.mean
            self.mean += off / self.n
            self.square += off * (v - self.mean)
            self.low, self.high = min(self.low, v), max(self.high, v)

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()

    def _closed(self) -> Iterator[tuple]:
        if self.epoch >= 0 and self.n > self.least:
            spread = math.sqrt(self.square / (self.n - 1)) if self.n > 1 else None
            yield self.key, self.epoch, self.first + self.epoch * self.step, self.n, self.mean, self.low, self.high, self.high - self.low, math.sqrt(self.square / self.n), spread
        self._clear()


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("epochs", udtf(Epochs))
