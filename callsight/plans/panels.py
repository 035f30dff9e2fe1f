"""The dashboard's eleven panels. Each takes the log rows of a time range (see `in_range`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.functions.numbers import (
    ERROR_RATE_LIMITS,
    P95_LIMITS_MS,
    panel_error_rate,
    round_even,
    severity,
    whole,
)
from callsight.functions.times import bucket_start
from callsight.operators.quantiles import percentiles
from callsight.plans.metrics import LATENCIES, P95, cost, errors, requests, tokens


def stat_requests(logs: DataFrame) -> DataFrame:
    return logs.agg(requests().alias("requests"))


def stat_error_rate(logs: DataFrame) -> DataFrame:
    return logs.agg(panel_error_rate(errors(), requests()).alias("error_rate"))


def stat_p95(logs: DataFrame, mode: str = "exact") -> DataFrame:
    raw = percentiles(mode)(logs, [], "latency_ms", P95)
    return raw.select(whole(F.col("p95")).alias("p95_ms"))


def stat_tokens(logs: DataFrame) -> DataFrame:
    return logs.agg(tokens().alias("tokens"))


def latency_percentiles(logs: DataFrame, interval_seconds: int, mode: str = "exact") -> DataFrame:
    """Unrounded p50, p95 and p99 per interval."""
    raw = percentiles(mode)(_by_time(logs, interval_seconds), ["time"], "latency_ms", LATENCIES)
    return raw.orderBy("time")


def throughput(logs: DataFrame, interval_seconds: int) -> DataFrame:
    return _by_time(logs, interval_seconds).groupBy("time").agg(requests().alias("requests")).orderBy("time")


def error_rate_over_time(logs: DataFrame, interval_seconds: int) -> DataFrame:
    rate = panel_error_rate(errors(), requests()).alias("error_rate_pct")
    return _by_time(logs, interval_seconds).groupBy("time").agg(rate).orderBy("time")


def ttft_p95(logs: DataFrame, interval_seconds: int, mode: str = "exact") -> DataFrame:
    """Time to the first token, over the calls that streamed one."""
    streamed = _by_time(logs.where(F.col("ttft_ms").isNotNull()), interval_seconds)
    raw = percentiles(mode)(streamed, ["time"], "ttft_ms", P95)
    return raw.select("time", whole(F.col("p95")).alias("ttft_p95")).orderBy("time")


def by_provider(logs: DataFrame, mode: str = "exact") -> DataFrame:
    raw = percentiles(mode)(
        logs, ["provider"], "latency_ms", P95, sums={"requests": requests(), "tokens": tokens()}
    )
    return raw.select("provider", "requests", whole(F.col("p95")).alias("p95_ms"), "tokens").orderBy(
        F.desc("requests"), "provider"
    )


def tokens_by_model(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy("model")
        .agg(
            requests().alias("requests"),
            tokens("prompt").alias("prompt"),
            tokens("completion").alias("completion"),
            tokens("total").alias("total"),
        )
        .orderBy(F.desc("total"), "model")
    )


def cost_by_provider(logs: DataFrame) -> DataFrame:
    """Providers that report no cost come last, with null."""
    return (
        logs.groupBy("provider")
        .agg(round_even(cost(), 6).alias("cost_usd"))
        .orderBy(F.desc_nulls_last("cost_usd"), "provider")
    )


def alerts(stats: DataFrame) -> DataFrame:
    """Colours of a row's `error_rate` and `p95_ms`."""
    return stats.withColumns(
        {
            "error_rate_level": severity(F.col("error_rate"), ERROR_RATE_LIMITS),
            "p95_level": severity(F.col("p95_ms"), P95_LIMITS_MS),
        }
    )


def _by_time(logs: DataFrame, interval_seconds: int) -> DataFrame:
    return logs.withColumn("time", bucket_start(F.col("created_at"), interval_seconds))
