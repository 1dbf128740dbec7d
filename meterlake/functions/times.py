"""Instants and calendar days (FN-01..04, FLT-17, FLT-18)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def iso_instant(text: Column) -> Column:
    """ISO-8601 text to an instant; no zone means UTC, junk gives null."""
    zoned = text.rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def iso_instant_or_oldest(text: Column) -> Column:
    """Lenient form: junk and null give the first instant of year 1."""
    return F.coalesce(iso_instant(text), F.try_to_timestamp(F.lit("0001-01-01T00:00:00Z")))


def millis_instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def as_wall_clock(df: DataFrame, column: str, zone: str | None) -> Column:
    """The column as local time of a zone (session zone if none). Timestamps without zone count as UTC."""
    target = F.lit(zone) if zone else F.current_timezone()
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), target, F.col(column))
    return F.convert_timezone(F.current_timezone(), target, F.col(column).cast("timestamp_ntz"))


def day_in_zone(df: DataFrame, column: str, zone: str | None) -> Column:
    return as_wall_clock(df, column, zone).cast("date")


def in_days(df: DataFrame, column: str, zone: str | None, since: date | None, until: date | None) -> DataFrame:
    """Rows whose day in the zone is in [since, until).

    Next to the exact test on the day stands a plain range of the stored value, widened by the
    largest zone offset, which reaches the Parquet scan.
    """
    day, kind = day_in_zone(df, column, zone), df.schema[column].dataType
    bound = lambda d: F.lit(f"{d.isoformat()} 00:00:00").cast(kind)
    out = df
    if since is not None:
        out = out.filter((F.col(column) >= bound(since - timedelta(days=2))) & (day >= F.lit(since)))
    if until is not None:
        out = out.filter((F.col(column) < bound(until + timedelta(days=2))) & (day < F.lit(until)))
    return out


def last_days(df: DataFrame, column: str, zone: str | None, today: date, days: int = 7) -> DataFrame:
    """Rows of the last `days` days up to and with today, and later ones."""
    return in_days(df, column, zone, today - timedelta(days=days - 1), None)
