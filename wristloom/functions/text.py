"""Column functions on times, names, flags and packed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS = {"d": 24.0, "h": 1.0, "m": 1 / 60, "s": 1 / 3600}


def duration_hours(text: Column) -> Column:
    """`20h`, `1200m`, `0.5d`, `90s` or a plain number of hours; null where it is none of these."""
    text = F.lower(F.trim(text))
    number = F.regexp_extract(text, r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*([dhms]?)$", 1)
    unit = F.regexp_extract(text, r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*([dhms]?)$", 2)
    factor = F.lit(1.0)
    for name, hours in HOURS.items():
        factor = F.when(unit == name, hours).otherwise(factor)
    return F.when(number != "", number.cast("double") * factor)


def truth(text: Column) -> Column:
    """yes, true, t and 1, in any case, are true; all else is false."""
    return F.coalesce(F.lower(text).isin("yes", "true", "t", "1"), F.lit(False))


def participant_id(path: Column) -> Column:
    """What stands after the last / of a path and before the next dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def zoned_instant(text: Column) -> Column:
    """The instant of `yyyy-MM-dd HH:mm:ss.SSS+hhmm [Zone]`; fraction and zone name may be missing."""
    plain = F.regexp_replace(text, r"\s*\[.*\]$", "")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSSxx")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssxx")),
        F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSSxxx")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssxxx")),
    )


def zone_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\[(.+)\]$", 1), F.lit(""))


def offset_minutes(instant: Column, zone: str) -> Column:
    """The zone's distance from UTC at an instant (a UTC timestamp)."""
    return ((F.unix_micros(F.from_utc_timestamp(instant, zone)) - F.unix_micros(instant)) / 60_000_000).cast("long")


def zoned_text(instant: Column, zone: str) -> Column:
    """`yyyy-MM-dd HH:mm:ss.SSS+hhmm [Zone]` of a UTC instant."""
    minutes = offset_minutes(instant, zone)
    sign = F.when(minutes < 0, "-").otherwise("+")
    hhmm = F.format_string("%s%02d%02d", sign, F.expr("1").cast("int") * F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    return F.concat(F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd HH:mm:ss.SSS"), hhmm, F.lit(f" [{zone}]"))


def ticks_millis(ticks: Column) -> Column:
    """Unix milliseconds of 100 ns ticks since the year 1."""
    return F.floor((ticks - F.lit(621355968000000000)) / 10_000).cast("long")


def shifted_millis(millis: Column, shift: Column) -> Column:
    """millis less a shift `±HH:MM:SS`, whose sign holds for all its parts."""
    sign = F.when(shift.startswith("-"), -1).otherwise(1)
    parts = F.split(F.regexp_replace(shift, "^[+-]", ""), ":")
    seconds = parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + F.coalesce(F.get(parts, F.lit(2)).cast("double").cast("long"), F.lit(0))
    return millis - sign * seconds * 1000


def packed(*values: Column) -> Column:
    """Values in one cell, separated by spaces."""
    return F.concat_ws(" ", *(v.cast("string") for v in values))


def unpacked(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda x: x.cast("double"))


def rounded_up(v: Column, places: int) -> Column:
    return F.ceil(v * 10**places) / 10**places


def mean_sd(mean: Column, sd: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f (%.{places}f)", mean, sd)


def mean_ci(mean: Column, sd: Column, n: Column, places: int = 2) -> Column:
    """mean (low - high) of the 95 % interval."""
    half = 1.96 * sd / F.sqrt(n)
    return F.format_string(f"%.{places}f (%.{places}f - %.{places}f)", mean, mean - half, mean + half)
