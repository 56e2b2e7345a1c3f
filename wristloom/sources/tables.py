"""Text tables: sensor CSV, epoch and label series, summaries, study files, models' feature lists; and their sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import zoned_instant, zoned_text
from .files import file_system
from .npy import read_npy, write_npy  # noqa: F401  beside the other sinks

# ---------------------------------------------------------------- sources


def sensor_csv(spark: SparkSession, path: str, start_row: int = 1, columns: tuple[int, ...] = (0, 1, 2, 3), time_format: str | None = None, rate: float | None = None, start: str | None = None) -> DataFrame:
    """path, t, x, y, z, temp of CSV or CSV.gz samples: ordinals of time, x, y, z and, if there is a fifth, temperature.

    Lines before start_row are skipped.  Times are `yyyy-MM-dd HH:mm:ss.SSS+hhmm [Zone]`, whose zone counts, or local ones
    of time_format.  Without a time column (a negative ordinal), times are start + line / rate.  Spark splits uncompressed
    files also where line numbers matter: they are a line's place in its split and the lines of the splits before.
    """
    if start_row > 0 or columns[0] < 0:
        lines = _numbered(spark, path).where((F.col("i") >= start_row) & (F.col("value") != ""))
    else:
        lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.lit(0).alias("i"), "value")
    part = F.split("value", ",")
    number = lambda k: F.get(part, F.lit(k)).cast("double")
    if columns[0] < 0:
        t = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + ((F.col("i") - start_row) * 1e6 / rate).cast("long")).cast("timestamp_ntz")
    else:
        text = F.trim(F.get(part, F.lit(columns[0])))
        t = F.to_timestamp_ntz(text, F.lit(time_format)) if time_format else zoned_instant(text).cast("timestamp_ntz")
    temp = number(columns[4]) if len(columns) > 4 else F.lit(0.0)
    return lines.select("path", t.alias("t"), *(number(c).alias(a) for c, a in zip(columns[1:4], "xyz", strict=True)), temp.alias("temp"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, i (line number from 0) and value of the lines of text files."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("at")
    lines = spark.read.text(path).select(at, F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("id"), "value")
    # a row per split of a file
    splits = lines.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("at.file_path").orderBy("at.file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("at").alias("split"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(splits, F.col("at") == F.col("split")).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("i"), "value")


def epoch_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An epoch table from CSV, its time column parsed with its zone."""
    raw = spark.read.csv(path, header=True, schema=schema.replace("time timestamp_ntz", "time string"))
    return raw.withColumn("time", zoned_instant(F.col("time")).cast("timestamp_ntz"))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All `*-summary.json` under a folder, one row each; keys that a file lacks are null."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*-[sS]ummary.json").json(folder)


def info_pairs(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value of `name: value` or `name:value` lines."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").where(F.col("value").contains(":"))
    return lines.select("path", F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.expr("substr(value, instr(value, ':') + 1)")).alias("value"))


def feature_list(spark: SparkSession, path: str) -> list[str]:
    """Names in a text file, one a line: a model's inputs, a bounded list."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def command_files(spark: SparkSession, path: str) -> DataFrame:
    """The second word of each line of a command list: its file."""
    return spark.read.text(path).select(F.col("value").alias("command"), F.get(F.split("value", " "), F.lit(1)).alias("file"))


# ---------------------------------------------------------------- sinks


def write_time_series(df: DataFrame, path: str, time: str, zone: str) -> None:
    """Gzipped CSV with the time as `yyyy-MM-dd HH:mm:ss.SSS+hhmm [Zone]`."""
    out = df.withColumn(time, zoned_text(F.col(time).cast("timestamp"), zone))
    out.write.mode("overwrite").option("compression", "gzip").option("header", True).csv(path)


def write_summary_json(long: DataFrame, path: str, key: str) -> None:
    """A line of JSON per recording from long form (key, metric, value)."""
    one = long.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))).alias("value"))
    one.select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(lines: Column, df: DataFrame, path: str) -> None:
    df.select(lines.alias("value")).write.mode("overwrite").text(path)


def write_raw_csv(samples: DataFrame, path: str) -> None:
    """t, x, y, z of calibrated samples, three decimals, gzipped."""
    out = samples.select("t", *(F.round(a, 3).alias(a) for a in "xyz"))
    out.write.mode("overwrite").option("compression", "gzip").option("header", True).csv(path)


def html_table(df: DataFrame, title: str) -> Iterator[str]:
    """Lines of an HTML page of a table, whose rows come one partition after the other."""
    yield f"<html><head><title>{title}</title></head><body><table>"
    yield "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    for row in df.toLocalIterator():
        yield "<tr>" + "".join(f"<td>{v}</td>" for v in row) + "</tr>"
    yield "</table></body></html>"


def exists(path: str) -> bool:
    files, name = file_system(path)
    return files.get_file_info(name).type != pafs.FileType.NotFound
