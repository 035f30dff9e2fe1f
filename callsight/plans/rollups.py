"""Stored, mergeable percentiles: a rollup row per hour, provider and model.

A row holds a KLL sketch of the latencies and exact sums. Sketches of any hours, providers and
models merge into one of the whole, so a window's summary reads a few rows per hour instead of
its calls. A percentile from merged sketches is a value that occurs, whose rank is off by less than
RANK_ERROR of the group (at SKETCH_K, in 99 of 100 cases by less than half of that); groups of
less than SKETCH_K calls are exact up to interpolation. Everything else is exact.

Rollups of a day are made when the day is settled, as a rule after its nightly compaction, and
replace what an earlier try has left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.times import as_time, bucket_start, hours, window_bucket, window_hours
from callsight.operators.logs import Time
from callsight.operators.quantiles import in_sets
from callsight.plans.metrics import LATENCIES, SETS, errors, in_sections, requests, tokens
from callsight.session import require_utc
from callsight.sources.logs import read_latest

ROLLUP_SECONDS = 3600
SKETCH_K = 800
RANK_ERROR = 0.01

SUMS = ["requests", "errors", "tokens", "cost", "ttft", "ttft_calls"]
ROLLUP_DDL = """t timestamp, provider string, model string, requests bigint, errors bigint, tokens bigint,
    cost decimal(38,12), ttft decimal(38,9), ttft_calls bigint, latencies binary, day date"""


def rollup(logs: DataFrame) -> DataFrame:
    """One row per hour, provider and model of log rows without copies."""
    hour = bucket_start(F.col("created_at"), ROLLUP_SECONDS)
    found = logs.groupBy(hour.alias("t"), "provider", "model").agg(
        requests().alias("requests"),
        errors().alias("errors"),
        tokens().alias("tokens"),
        F.sum(F.col("cost_usd").cast("decimal(38,12)")).alias("cost"),
        F.sum(F.col("ttft_ms").cast("decimal(38,9)")).alias("ttft"),
        F.count("ttft_ms").alias("ttft_calls"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("latencies"),
    )
    return found.withColumn("day", F.to_date("t"))


def write_rollups(spark: SparkSession, logs_path: str, path: str, days: Iterable[dt.date]) -> None:
    """Make the rollups of whole days of the log table; a day's rows replace earlier ones."""
    require_utc(spark)
    days = sorted(days)
    if not days:
        return
    last = dt.datetime.combine(days[-1], dt.time.max)
    rows = read_latest(spark, logs_path, str(days[0]), str(last)).where(F.col("day").isin(days))
    # a few rows per hour: one file a day
    rollup(rows.drop("day")).repartition("day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(path)


def read_rollups(spark: SparkSession, path: str, since: Time | None = None) -> DataFrame:
    rows = spark.read.schema(ROLLUP_DDL).parquet(path)
    if since is None:
        return rows
    return rows.where((F.col("day") >= F.to_date(as_time(since))) & (F.col("t") >= as_time(since)))


def merged(rollups: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], probs: dict[str, float]) -> DataFrame:
    """Sums and percentiles of the groups of several groupings, from rollup rows alone.

    Every task merges what it has of a group before the shuffle, which moves one sketch each.
    """
    rows, by = in_sets(rollups, keys, sets)
    found = rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.kll_merge_agg_double("latencies", SKETCH_K).alias("_l")
    )
    points = F.when(
        F.kll_sketch_get_n_double("_l") > 0, F.kll_sketch_get_quantile_double("_l", F.lit(list(probs.values())))
    )
    return found.withColumn("_p", points).select(
        *by, *SUMS, *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)]
    )


def window_groups(rollups: DataFrame, window: str, as_of: Time) -> DataFrame:
    """The groups of a summary's four parts, percentiles not rounded."""
    since = bucket_start(as_time(as_of) - hours(window_hours(window)), ROLLUP_SECONDS)
    rows = rollups.where((F.col("t") >= since) & (F.col("day") >= F.to_date(since)))
    bucket = bucket_start(F.col("t"), max(window_bucket(window), ROLLUP_SECONDS))
    return merged(rows.withColumn("t", bucket), ["t", "provider", "model"], SETS, LATENCIES)


def summary_from_rollups(rollups: DataFrame, window: str, as_of: Time) -> DataFrame:
    """The rows of `metrics.summary`, from rollup rows alone.

    Windows begin with the hour that holds their start, and buckets of the time series are no
    finer than an hour.
    """
    groups = window_groups(rollups, window, as_of)
    return in_sections(groups.withColumn("cost", F.col("cost").cast("double")))
