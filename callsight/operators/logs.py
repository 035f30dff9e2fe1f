"""Operators on the log table: time filters, retention, removal of copies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.functions.times import RETENTION_DAYS, as_time, days, hours, to_seconds, window_hours
from callsight.schemas import LOG_KEYS

Time = str | datetime | Column


def _from(df: DataFrame, start: Column) -> Column:
    """created_at >= start, said again for the partition column where there is one."""
    keep = F.col("created_at") >= start
    return keep & (F.col("day") >= F.to_date(start)) if "day" in df.columns else keep


def _until(df: DataFrame, end: Column) -> Column:
    keep = F.col("created_at") <= end
    return keep & (F.col("day") <= F.to_date(end)) if "day" in df.columns else keep


def in_window(df: DataFrame, window: str, as_of: Time) -> DataFrame:
    """Rows of the last 1h, 24h or 7d. There is no upper bound: rows from the future count."""
    return df.where(_from(df, as_time(as_of) - hours(window_hours(window))))


def in_range(df: DataFrame, start: Time, end: Time) -> DataFrame:
    """Rows of a dashboard's time range, both ends included."""
    return df.where(_from(df, as_time(start)) & _until(df, as_time(end)))


def last_hours(df: DataFrame, n: int, as_of: Time) -> DataFrame:
    """The dashboard's default range is the last 6 hours."""
    return in_range(df, as_time(as_of) - hours(n), as_of)


def retain(df: DataFrame, as_of: Time, keep_days: int = RETENTION_DAYS) -> DataFrame:
    """Rows whose age, to the second, is below the retention."""
    oldest = as_time(as_of) - days(keep_days)
    keep = to_seconds(F.col("created_at")) > oldest
    return df.where(keep & _from(df, to_seconds(oldest)))


def dedup_latest(
    df: DataFrame, keys: Sequence[str] = LOG_KEYS, version: str = "ingested_at", ties: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the one with the latest version.

    Rows of one key and version are copies of one event, so either may stay; name
    `ties` where that does not hold. Every task first cuts its own copies down to one
    per key, so a key with very many copies does not load one task.
    """
    by = [*(["day"] if "day" in df.columns and "created_at" in keys else []), *keys]
    newest = Window.partitionBy(*by).orderBy(F.desc(version), *[F.desc(c) for c in ties])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Adds `_slot`, a part of the key's hash. Rows grouped by (key, _slot) make the same
    groups as by the key alone but lie elsewhere, so a join by the key shuffles them anew.
    Adaptive execution splits a hot key of the other side only where both sides of the
    join come straight from a shuffle."""
    return df.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(64)))


def dedup_stream(df: DataFrame, delay: str, keys: Sequence[str] = LOG_KEYS) -> DataFrame:
    """The first copy of each key in a stream; copies may come `delay` apart."""
    return df.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(list(keys))
