"""From samples to summaries: the whole run for all recordings of a table at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import NoData
from ..operators import calibration, circadian, epochs as ep, impute, labels, runs, signal, summarise
from ..sources.shared import written
from . import activity
from .activity import ActivityModel


def between(df: DataFrame, ts: str, config: Config) -> DataFrame:
    """Rows from start to end, both inclusive, in the recording's own time."""
    out = df
    if config.start:
        out = out.where(F.col(ts) >= F.lit(config.start).cast("timestamp_ntz"))
    if config.end:
        out = out.where(F.col(ts) <= F.lit(config.end).cast("timestamp_ntz"))
    return out


def calibration_table(samples: DataFrame, key: str, config: Config) -> DataFrame | None:
    """Coefficients per recording from its stationary ten-second epochs; given ones for all; or none."""
    if config.coefficients is not None:
        return samples.select(key).distinct().select(key, *(F.lit(float(v)).alias(k) for k, v in config.coefficients.items()))
    if not config.calibrate:
        return None
    raw = signal.calibrate_samples(samples, None, key, config.sensor_range)
    short = signal.epoch_features(raw, key, 10, config.sample_rate, with_features=False, low_pass=config.low_pass, resample=config.resample)
    return calibration.calibrate(calibration.stationary_points(short, config.stationary_std), key)


def epoch_table(samples: DataFrame, key: str, config: Config) -> tuple[DataFrame, DataFrame | None]:
    """(epochs, coefficients), both written: samples (key, t, x, y, z, temp) are read once for each."""
    cut = between(samples, "t", config)
    coefficients = calibration_table(cut, key, config)
    if coefficients is not None:
        coefficients = written(coefficients, "calibration")
    fixed = signal.calibrate_samples(cut, coefficients, key, config.sensor_range, [config.arrival] if config.arrival else [])
    out = signal.epoch_features(fixed, key, config.epoch_period, config.sample_rate, config.features, config.low_pass, resample=config.resample, arrival=config.arrival)
    return written(out, "epochs"), coefficients


def labelled(worn: DataFrame, key: str, config: Config, model: ActivityModel | None) -> tuple[DataFrame, list[str]]:
    """worn epochs with what is summarised of them, and its names: acc, the model's labels and METs, cut points."""
    table = worn.withColumn("acc", F.col("enmoTrunc") * 1000)
    cuts = labels.cut_point_columns(F.col("enmoTrunc"), config.cuts)
    if model is None:
        return table.withColumns(cuts), ["acc", *cuts]
    names = model.labels
    tolerance = config.sleep_tolerance_minutes * 60 / config.epoch_period
    table = activity.classify(model, table, key, "time", enmo="enmoTrunc", sleep="sleep" if "sleep" in names else None, sleep_rows=tolerance, cuts=config.cuts)
    return table, ["acc", *names, *(["MET"] if model.mets else []), *cuts]


def summarise_epochs(epochs: DataFrame, key: str, config: Config, model: ActivityModel | None = None, coefficients: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(time series, metrics): labelled epochs, imputed, and metrics in long form (key, metric, value)."""
    cut = between(epochs, "time", config)
    if cut.isEmpty():
        raise NoData("no epochs between start and end")
    full = ep.regrid(cut, key, "time", config.epoch_period)
    still = runs.stationary(["xStd", "yStd", "zStd"], config.nonwear_std)
    worn = runs.mask_nonwear(full, key, "time", still, config.nonwear_minutes)
    table, values = labelled(worn, key, config, model)
    table = written(table.select(key, "time", "missing", *values), "labelled-epochs")
    parts = [_wear(full, table, cut, key, config, still), _days(table, key, values, config), *_quality(cut, coefficients, key, config)]
    if config.min_wear_hours:
        table = summarise.exclude_days(table, key, "time", values, ~F.col("missing"), config.epoch_period, config.min_wear_hours)
    filled = written(impute.impute(table.select(key, "time", "missing", *values), key, "time", values), "imputed-epochs")
    cube = written(summarise.weekday_hour_cube(filled, key, "time", values), "cube")
    parts += [summarise.mean_of_means(cube, key, c) for c in values]
    over = summarise.overall(table, key, values)
    parts.append(_long(over, key, {f"{c}_{n}": f"{c}-overall-{n}" for c in values for n in ("avg", "sd")}))
    if config.circadian:
        parts += _circadian(filled, key, config, values if model is not None and "sleep" in values and not config.circadian_of_acc else None)
    if config.ecdf:
        levels = summarise.ecdf(table, key, "time", "acc", legacy=config.legacy_ecdf)
        parts.append(levels.select(key, F.concat(F.lit("acc-ecdf-"), F.col("level").cast("string"), F.lit("mg")).alias("metric"), F.col("ecdf").alias("value")))
    return filled.withColumnRenamed("missing", "imputed"), reduce(DataFrame.unionByName, parts)


def _wear(full: DataFrame, table: DataFrame, cut: DataFrame, key: str, config: Config, still) -> DataFrame:
    wear = runs.wear_time(table, key, "time", config.epoch_period)
    bouts = runs.nonwear_bouts(full, key, "time", still, config.nonwear_minutes).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("bouts"))
    wear = wear.join(bouts, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("bouts", F.coalesce("bouts", F.lit(0)))
    gaps = ep.interrupts(cut, key, "time", config.epoch_period)
    names = {"wear_days": "wearTime-overall(days)", "nonwear_days": "nonWearTime-overall(days)", "good_wear": "quality-goodWearTime", "bouts": "wearTime-numNonWearEpisodes(>1hr)"}
    return _long(wear, key, names).unionByName(_long(gaps, key, {"interrupts_num": "errs-interrupts-num", "interrupt_mins": "errs-interrupt-mins"}))


def _days(table: DataFrame, key: str, values: list[str], config: Config) -> DataFrame:
    """Recorded hours of every calendar day, of wear and of each label, and which days count."""
    columns = [c for c in values if c not in ("acc", "MET")]
    rows = table.select(key, "time", (~F.col("missing")).cast("double").alias("wearTime"), *(F.col(c).cast("double").alias(c) for c in columns))
    days = summarise.daily_hours(rows, key, "time", ["wearTime", *columns], config.epoch_period)
    least = config.min_wear_hours or 0
    days = days.withColumn("_in", (F.col("wearTime_hours") >= least).cast("double"))
    named = lambda text: F.concat(F.lit("day"), F.col("day_number").cast("string"), F.lit(text))
    cells = [F.struct(named(f"-recorded-{c}(hrs)").alias("metric"), F.coalesce(f"{c}_hours", F.lit(0.0)).alias("value")) for c in ("wearTime", *columns)]
    if not config.min_wear_hours:
        return days.select(key, F.explode(F.array(*cells)).alias("p")).select(key, "p.metric", "p.value")
    cells.append(F.struct(named("-includedInSummary").alias("metric"), F.col("_in").alias("value")))
    counts = days.groupBy(key).agg(F.sum(1 - F.col("_in")).alias("out"), F.sum("_in").alias("in"), F.lit(float(least)).alias("least"))
    names = {"out": "wearTime-numDaysExcluded", "in": "wearTime-numDaysIncluded", "least": "wearTime-minWearPerDayThreshold(hrs)"}
    return days.select(key, F.explode(F.array(*cells)).alias("p")).select(key, "p.metric", "p.value").unionByName(_long(counts, key, names))


def _quality(cut: DataFrame, coefficients: DataFrame | None, key: str, config: Config) -> list[DataFrame]:
    """Totals of samples, clips and errors, a change of clocks, the weekday of the start, and the calibration."""
    instants = cut.withColumn("_utc", F.to_utc_timestamp(F.col("time").cast("timestamp"), config.zone))
    totals = summarise.quality(instants, key, "_utc", config.zone)
    more = cut.groupBy(F.col(key).alias("_key")).agg(F.sum("dataErrors").alias("errors"), ((F.dayofweek(F.min("time")) + 5) % 7).alias("first_day"))
    totals = totals.join(more, F.col(key).eqNullSafe(F.col("_key")))
    names = {
        "total_reads": "totalReads", "clips_before": "clipsBeforeCalibration", "clips_after": "clipsAfterCalibration", "dst_crossover": "quality-daylightSavingsCrossover",
        "errors": "errs-data", "first_day": "firstDay(0=mon,6=sun)",
    }
    out = [_long(totals, key, names)]
    if coefficients is not None:
        kinds = {"offset": "Offset(g)", "slope": "Slope", "temp_slope": "SlopeTemp"}
        named = {f"{a}_{p}": f"calibration-{a}{text}" for a in "xyz" for p, text in kinds.items() if f"{a}_{p}" in coefficients.columns}
        out.append(_long(coefficients, key, named))
        if "good" in coefficients.columns:
            own = coefficients.withColumns({"before": F.col("error_before") * 1000, "after": F.col("error_after") * 1000, "own": F.lit(1)})
            out.append(_long(own, key, {"before": "calibration-errsBefore(mg)", "after": "calibration-errsAfter(mg)", "n_points": "calibration-numStaticPoints", "good": "quality-goodCalibration", "own": "quality-calibratedOnOwnData"}))
    return out


def _circadian(filled: DataFrame, key: str, config: Config, names: list[str] | None) -> list[DataFrame]:
    """Of sleep or not where there are labels (names, cut points among them), else of acceleration; M10 and L5 of acceleration."""
    columns = [c for c in names if c not in ("acc", "MET")] if names else []
    rows = filled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("acc", *columns)})
    wave = circadian.sleep_signal(columns) if names else F.col("acc")
    power = circadian.daily_power(rows, key, "time", wave, config.epoch_period)
    main = circadian.dominant_frequency(rows, key, "time", wave, config.epoch_period)
    ten = circadian.m10_l5(rows, key, "time", "acc", config.epoch_period)
    return [_long(power, key, {"psd": "PSD"}), _long(main, key, {"frequency": "fourier-frequency"}), _long(ten, key, {"relative_amplitude": "M10L5"})]


def _long(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for c, n in names.items())))
    return df.select(key, pairs.alias("p")).select(key, "p.metric", "p.value")


def process(samples: DataFrame, key: str, config: Config | None = None, model: ActivityModel | None = None) -> dict[str, DataFrame | None]:
    """Epochs, calibration, time series and metrics of all recordings of samples (key, t, x, y, z, temp, and config.arrival if it is set).

    With a model, epochs are labelled by it; its features must be among the epochs' columns.
    """
    config = config or Config()
    epochs, coefficients = epoch_table(samples, key, config)
    series, metrics = summarise_epochs(epochs, key, config, model, coefficients)
    return {"epochs": epochs, "calibration": coefficients, "series": series, "metrics": metrics}
