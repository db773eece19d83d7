"""Dates of files (F-15 to F-20, P-14): from EXIF, else from the name, else unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import stem

#: The date pattern in names and the earliest believable day.
NAME_DATE = r"(?<!\d)((?:19|20)\d{2})([-_.]?)(\d{2})\2(\d{2})(?!\d)"
EARLIEST = "1990-01-01"
#: Epoch seconds of years 1 to 9999: what a date can hold.
DATE_RANGE = (-62135596800.0, 253402300799.0)


def believable(day: Column, as_of: Column) -> Column:
    """P-14: from EARLIEST to the day after as_of."""
    return day.between(F.to_date(F.lit(EARLIEST)), F.date_add(as_of, 1))


def date_from_name(name: Column, as_of: Column) -> Column:
    """F-15: the first match in the name that is a believable calendar day."""
    digits = F.transform(F.regexp_extract_all(stem(name), F.lit(NAME_DATE), F.lit(0)), lambda m: F.regexp_replace(m, "[-_.]", ""))
    days = F.transform(digits, lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date"))
    return F.get(F.filter(days, lambda d: d.isNotNull() & believable(d, as_of)), 0)


def exif_epoch(text: Column) -> Column:
    """F-16: `YYYY:MM:DD HH:MM:SS` as epoch seconds in the session's time zone; anything else is null."""
    return F.unix_timestamp(F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double")


def epoch_date(seconds: Column) -> Column:
    """F-17: the local day of epoch seconds; null beyond what a date can hold."""
    return F.when(seconds.between(*DATE_RANGE), F.to_date(F.timestamp_seconds(F.when(seconds.between(*DATE_RANGE), seconds))))


def resolve_date(exif: Column, name: Column, as_of: Column) -> tuple[Column, Column]:
    """F-18: (day, source); source is exif, filename or unknown."""
    taken = epoch_date(exif)
    taken = F.when(believable(taken, as_of), taken)
    named = date_from_name(name, as_of)
    return F.coalesce(taken, named), F.when(taken.isNotNull(), "exif").when(named.isNotNull(), "filename").otherwise("unknown")


def month_folder(day: Column) -> Column:
    """F-19: `YYYY/YYYY-MM`."""
    return F.concat_ws("/", F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM"))


def time_label(seconds: Column) -> Column:
    """F-20: `YYYY-MM-DD HH:MM:SS`, empty where there is no such time."""
    inside = F.when(seconds.between(*DATE_RANGE), seconds)
    return F.coalesce(F.date_format(F.timestamp_seconds(inside), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
