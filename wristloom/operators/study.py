"""Operators over a study's files and summaries: collation, reprocessing lists, calibration repair, quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import packed, participant_id

CALIBRATION = tuple(f"calibration-{a}{p}" for p in ("Offset(g)", "Slope", "SlopeTemp") for a in "xyz")


def unprocessed(files: DataFrame, done: DataFrame, file_col: str = "fileName", done_col: str = "file-name") -> DataFrame:
    """Files that no summary names."""
    return files.join(done.select(F.col(f"`{done_col}`").alias("_done")), F.col(file_col) == F.col("_done"), "left_anti")


def neighbours_asof(rows: DataFrame, known: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """rows with previous and next: the value of the nearest known row strictly before and after, per key.

    One sort of both tables together; at the same time, known rows are neither before nor after.
    """
    both = known.select(key, F.col(ts).alias("_ts"), F.struct(F.col(value).alias("v")).alias("_k"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row")).unionByName(
        rows.select(key, F.col(ts).alias("_ts"), F.lit(None).cast(known.select(F.struct(F.col(value).alias("v"))).schema[0].dataType).alias("_k"), F.struct("*").alias("_row"))
    )
    t = F.unix_micros(F.col("_ts").cast("timestamp"))
    order = Window.partitionBy(key).orderBy(t)
    out = both.withColumns({
        "previous": F.last("_k", True).over(order.rangeBetween(Window.unboundedPreceding, -1)),
        "next": F.first("_k", True).over(order.rangeBetween(1, Window.unboundedFollowing)),
    }).where("_row IS NOT NULL")
    return out.select("_row.*", F.col("previous.v").alias("previous"), F.col("next.v").alias("next"))


def repaired(rows: DataFrame, good: Column, key: str, ts: str, value: str) -> DataFrame:
    """The rows that are not good, with the value of the latest good one before, else the first after; others go."""
    bad = rows.where(~F.coalesce(good, F.lit(False)))
    found = neighbours_asof(bad, rows.where(good), key, ts, value)
    return found.withColumn("borrowed", F.coalesce("previous", "next")).where("borrowed IS NOT NULL")


def calibration_cells(summary: DataFrame) -> DataFrame:
    """calOffset, calSlope and calTemp cells of a study summary, each three numbers with spaces between."""
    cells = {f"cal{n}": packed(*(F.col(f"`calibration-{a}{p}`") for a in "xyz")) for n, p in (("Offset", "Offset(g)"), ("Slope", "Slope"), ("Temp", "SlopeTemp"))}
    return summary.select(F.col("`file-name`").alias("fileName"), *(v.alias(k) for k, v in cells.items()))


def collated(summaries: DataFrame, path_col: str = "file-name") -> DataFrame:
    """Summaries with eid, the participant's id from the path."""
    return summaries.select(participant_id(F.col(f"`{path_col}`")).alias("eid"), "*")


def commands(files: DataFrame, path_col: str, program: str, out_dir: str, options: dict[str, Column] | None = None) -> DataFrame:
    """One shell command per file, with options where their columns are not null."""
    path = F.col(path_col)
    given = [F.when(c.isNotNull(), F.concat(F.lit(f"--{name} "), c.cast("string"))) for name, c in (options or {}).items()]
    quoted = F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    out = F.concat(F.lit(f"--outputFolder '{out_dir}/"), participant_id(path), F.lit("/'"))
    return files.select(F.concat_ws(" ", F.lit(program), quoted, out, *given).alias("command"))


def replaced_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table without the keys of new, and then new; columns that one lacks are null."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def duplicate_names(files: DataFrame, path_col: str) -> DataFrame:
    """Base names that several paths share: name, n."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts of equal-width bins between a column's least and largest value; the last bin is closed."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    v, a, b = F.col(value), F.col("_a"), F.col("_b")
    at = F.when(b == a, 0).otherwise(F.least(F.floor((v - a) / (b - a) * bins), F.lit(bins - 1)))
    rows = df.where(v.isNotNull()).crossJoin(F.broadcast(ends))  # one row
    counts = rows.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    wide = (F.col("_b") - F.col("_a")) / bins
    return counts.select("bin", (F.col("_a") + F.col("bin") * wide).alias("low"), (F.col("_a") + (F.col("bin") + 1) * wide).alias("high"), "n")


def batch_report(results: DataFrame, ok: str = "ok", seconds: str = "seconds") -> DataFrame:
    """One row: runs, failed, and the mean seconds of successes."""
    good = F.col(ok)
    return results.agg(F.count("*").alias("runs"), F.sum((~good).cast("int")).cast("long").alias("failed"), F.avg(F.when(good, F.col(seconds))).alias("mean_seconds"))


def failed_runs(results: DataFrame, ok: str = "ok", seconds: str = "seconds", name: str = "name") -> DataFrame:
    """A row per failed run, in the order of their names, beside the counts of batch_report."""
    report = batch_report(results, ok, seconds)  # one row
    return results.where(~F.col(ok)).select(name).join(F.broadcast(report)).orderBy(name)


def summed_confusions(tables: DataFrame, true: str, counts: list[str], order: list[str]) -> DataFrame:
    """Confusion tables summed cell by cell, with labels in a given order."""
    place = F.create_map(*(x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))))
    return tables.groupBy(true).agg(*(F.sum(c).alias(c) for c in counts)).orderBy(F.coalesce(place[F.col(true)], F.lit(len(order))), true)
