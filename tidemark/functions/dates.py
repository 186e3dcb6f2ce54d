"""Calendar arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def release_time(report_date: Column) -> Column:
    """H9: the Friday strictly after the report date, 20:30 UTC (no daylight saving, on purpose)."""
    friday = F.next_day(report_date.cast("date"), "FRI").cast("timestamp_ntz")
    return friday + F.expr("INTERVAL '20:30' HOUR TO MINUTE")


def parse_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd")) -> Column:
    """First format that fits, null if none does."""
    cleaned = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(cleaned, F.lit(f)).cast("date") for f in formats])


def report_date(raw: Column) -> Column:
    """Report dates as YYYY-MM-DD or YYMMDD, also when the latter was read as a number.

    A leading zero lost by a numeric read is put back; unusable values give null.
    """
    text = F.trim(raw.cast("string"))
    digits = F.regexp_extract(text, r"^(\d{1,6})(?:\.0*)?$", 1)
    short = F.when(digits != "", F.lpad(digits, 6, "0"))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    # two-digit years: 69-99 are the 1900s, the rest the 2000s
    century = F.when(F.substring(short, 1, 2).cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    return F.coalesce(
        F.try_to_timestamp(iso, F.lit("yyyy-M-d")).cast("date"),
        F.try_to_timestamp(F.concat(century, short), F.lit("yyyyMMdd")).cast("date"),
    )


def year_fraction(start: Column, end: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date")) / F.lit(365.0)


def weekdays_between(start: Column, end: Column) -> Column:
    """H8: Mondays to Fridays among start+1d, start+2d, ... not later than ``end``.

    Whole days are stepped from the clock time of ``start``, so the number of
    steps is the whole days elapsed; full weeks count five and the rest of the
    week follows from the weekday of ``start``.
    """
    start_ts, end_ts = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    elapsed = F.unix_micros(end_ts.cast("timestamp")) - F.unix_micros(start_ts.cast("timestamp"))
    days = F.greatest(F.floor(elapsed / F.lit(86_400_000_000)), F.lit(0))
    first = F.weekday(start_ts)  # Monday = 0
    rest = days % 7
    # weekend days among first+1 .. first+rest (mod 7)
    saturday = ((F.lit(5) - first + 6) % 7) + 1  # steps until the next Saturday, 1..7
    sunday = ((F.lit(6) - first + 6) % 7) + 1
    weekend = (saturday <= rest).cast("int") + (sunday <= rest).cast("int")
    return (F.floor(days / 7) * 5 + rest - weekend).cast("long")


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5
