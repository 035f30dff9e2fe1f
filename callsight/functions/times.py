"""Time rules: buckets, days, text forms. All in the session time zone, which is UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-back in hours and bucket in seconds of each named window.
WINDOWS = {"1h": (1, 60), "24h": (24, 1800), "7d": (168, 21600)}
RETENTION_DAYS = 90


def as_time(value: str | datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def window_hours(window: str) -> int:
    return _window(window)[0]


def window_bucket(window: str) -> int:
    return _window(window)[1]


def _window(window: str) -> tuple[int, int]:
    if window not in WINDOWS:
        raise ValueError(f"window must be one of {', '.join(WINDOWS)}, not {window!r}")
    return WINDOWS[window]


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def bucket_start(col: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval that holds the time."""
    return F.window(col, f"{seconds} seconds")["start"]


def day(col: Column) -> Column:
    return F.to_date(col)


def day_number(col: Column) -> Column:
    """20240131 for 2024-01-31."""
    return F.date_format(col, "yyyyMMdd").cast("int")


def to_millis(col: Column) -> Column:
    return F.date_trunc("MILLISECOND", col)


def to_seconds(col: Column) -> Column:
    return F.date_trunc("SECOND", col)


def millis_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)


def iso_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def iso_millis(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS")
