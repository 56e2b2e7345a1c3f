"""python -m wristloom process FOLDER --out FOLDER | commands FOLDER --out FILE | collate FOLDER --out FOLDER

process exits with 1 if a recording failed, and with 2 if its arguments contradict each other.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import RecordingError
from .plans import activity, batch
from .sources import files, tables

SWITCHES = {f.name: f for f in fields(Config) if f.type in ("bool", bool)}
VALUES = {"epoch_period": int, "sample_rate": int, "low_pass": float, "sensor_range": float, "stationary_std": float, "resample": str, "nonwear_std": float, "nonwear_minutes": float, "zone": str, "start": str, "end": str, "sleep_tolerance_minutes": float, "min_wear_hours": float}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wristloom")
    parts = top.add_subparsers(dest="command", required=True)
    run = parts.add_parser("process", help="recordings to summaries")
    run.add_argument("folder")
    run.add_argument("--out", required=True)
    run.add_argument("--model", help="a folder that activity.save has written")
    run.add_argument("--coefficients", type=json.loads, help='JSON of given calibration, as {"x_offset": 0.01, "x_slope": 1.0}')
    run.add_argument("--csv", type=json.loads, default={}, help="JSON of arguments for CSV files: start_row, columns, time_format, rate, start")
    for name, kind in VALUES.items():
        run.add_argument(f"--{name.replace('_', '-')}", type=kind, default=None)
    for name, f in SWITCHES.items():
        run.add_argument(f"--{name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=f.default)
    commands = parts.add_parser("commands", help="a line for each recording of a folder that processes it alone")
    commands.add_argument("folder")
    commands.add_argument("--out", required=True)
    commands.add_argument("--results", default="results")
    collate = parts.add_parser("collate", help="summaries of all runs under a folder as one table")
    collate.add_argument("folder")
    collate.add_argument("--out", required=True)
    return top


def config_of(args: argparse.Namespace) -> Config:
    given = {k: getattr(args, k) for k in VALUES if getattr(args, k) is not None} | {k: getattr(args, k) for k in SWITCHES}
    return Config(**given, coefficients=args.coefficients)


def process(spark: SparkSession, args: argparse.Namespace) -> int:
    config = config_of(args)
    model = activity.load(args.model, spark) if args.model else None
    csv = {k: tuple(v) if isinstance(v, list) else v for k, v in args.csv.items()}
    run = batch.process_files(spark, args.folder, config, model, **csv)
    batch.save(run, args.out, config)
    counts = batch.report(run).first()
    print(f"{counts['runs']} recordings, {counts['failed']} failed")
    for row in run.status.where("NOT ok").orderBy("path").limit(20).collect():
        print(f"{row['path']}: {row['message']}")
    return 1 if counts["failed"] or not counts["runs"] else 0


def commands(spark: SparkSession, args: argparse.Namespace) -> int:
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    name = F.concat(F.lit(f"{args.results.rstrip('/')}/"), F.substring_index("path", "/", -1))
    line = F.concat(F.lit("python -m wristloom process "), quoted(F.col("path")), F.lit(" --out "), quoted(name))
    tables.write_lines(line, files.discover(spark, args.folder).coalesce(1), args.out)
    return 0


def collate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Runs write a line of JSON per recording under `summary`; metrics that a recording lacks are empty."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").json(args.folder)
    tables.write_csv(found.coalesce(1), args.out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("wristloom").getOrCreate()
    try:
        return {"process": process, "commands": commands, "collate": collate}[args.command](spark, args)
    except RecordingError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
