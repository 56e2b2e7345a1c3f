"""Many recordings in one run: files in, summaries and a status for every file out.

A file that cannot be read, or gives no epoch, is a row with ok = false; the others go on.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import NoData
from ..operators import study
from ..sources import actigraph, axivity, geneactiv, tables
from ..sources.files import FAILED, discover, format_of
from ..sources.shared import written
from . import recording
from .activity import ActivityModel

SOURCES = {"axivity": axivity, "geneactiv": geneactiv, "actigraph": actigraph}
EMPTY = "path string, error string"
#: What a short summary shows.
SHORT = ("acc-overall-avg", "wearTime-overall(days)", "nonWearTime-overall(days)", "quality-goodWearTime")


@dataclass
class Run:
    """Results by path: epochs, calibration, series and metrics (None if no file could be read), and status, a row per file."""

    results: dict[str, DataFrame | None] | None
    status: DataFrame


def samples_of(spark: SparkSession, folder: str, config: Config, **csv) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(samples or None, files, failures) of a file or folder: samples have path, t, x, y, z, temp; failures path and error.

    Pages are decoded once, into a written table.  csv are arguments of tables.sensor_csv, for .csv files.
    """
    files = written(discover(spark, folder).select("path"), "files")
    found = {format_of(r["suffix"]) for r in files.select(F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+(\.(gz|zip|bz2|xz))?)$", 1)).alias("suffix")).distinct().collect()}
    samples, failures = None, spark.createDataFrame([], EMPTY)
    for name in sorted(found):
        if name == "csv":
            part = tables.sensor_csv(spark, folder if folder.lower().endswith((".csv", ".csv.gz")) else f"{folder.rstrip('/')}/*.csv*", **csv)
        else:
            SOURCES[name].register(spark)
            pages = spark.read.format(name).load(folder)
            if name == "axivity" and config.start and config.end:
                pages = axivity.between(pages, config.start, config.end)
            pages = written(pages, f"{name}-pages")
            failures = failures.unionByName(pages.where(F.col("error").startswith(FAILED)).select("path", F.substring("error", len(FAILED) + 1, 1 << 20).alias("error")))
            part = SOURCES[name].samples(pages)
        part = part.select("path", "t", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "temp")))
        samples = part if samples is None else samples.unionByName(part)
    return samples, files, failures


def _plain(path):
    """A path without its scheme: sources and Spark's readers write it differently."""
    return F.regexp_replace(path, r"^[a-z]+:/+", "/")


def process_files(spark: SparkSession, folder: str, config: Config | None = None, model: ActivityModel | None = None, **csv) -> Run:
    """The whole run over a file or a folder of recordings.  status: path, ok, message, seconds (of the run, over its files)."""
    config, began = config or Config(), time.monotonic()
    samples, files, failures = samples_of(spark, folder, config, **csv)
    results = None
    if samples is not None:
        good = samples.join(failures.select(F.col("path").alias("_bad")).distinct(), F.col("path") == F.col("_bad"), "left_anti")
        try:
            results = recording.process(good, "path", config, model)
        except NoData:
            results = None
    done = results["epochs"].select("path").distinct() if results else spark.createDataFrame([], "path string")
    status = files.select("path", _plain(F.col("path")).alias("_p"))
    bad = failures.groupBy(_plain(F.col("path")).alias("_bad")).agg(F.min("error").alias("error"))
    status = status.join(done.select(_plain(F.col("path")).alias("_done")), F.col("_p") == F.col("_done"), "left").join(bad, F.col("_p") == F.col("_bad"), "left")
    ok = F.col("_done").isNotNull() & F.col("error").isNull()
    seconds = (time.monotonic() - began) / max(1, files.count())
    message = F.when(~ok, F.coalesce("error", F.lit("no epoch between start and end")))
    return Run(results, written(status.select("path", ok.alias("ok"), message.alias("message"), F.lit(seconds).alias("seconds")), "status"))


def save(run: Run, folder: str, config: Config) -> None:
    """series (CSV with zoned times), summary (a line of JSON per recording), epochs (Parquet) and status (CSV) under folder."""
    if run.results:
        tables.write_time_series(run.results["series"], f"{folder}/series", "time", config.zone)
        tables.write_summary_json(run.results["metrics"], f"{folder}/summary", "path")
        run.results["epochs"].write.mode("overwrite").parquet(f"{folder}/epochs")
    tables.write_csv(run.status.coalesce(1), f"{folder}/status")


def short_summary(metrics: DataFrame) -> DataFrame:
    """path and the metrics of SHORT, as columns."""
    return metrics.where(F.col("metric").isin(*SHORT)).groupBy("path").pivot("metric", list(SHORT)).agg(F.first("value"))


def report(run: Run) -> DataFrame:
    return study.batch_report(run.status)
