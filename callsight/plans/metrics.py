"""The metrics summary: totals, a time series, and breakdowns by provider and model.

Every function takes the log rows it should count. `as_of` is an argument, so the four
parts of one summary see the same window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.functions.numbers import error_rate, round_even, whole, zero_float, zero_int
from callsight.functions.times import bucket_start, iso_text, millis_between, window_bucket
from callsight.operators.logs import Time, dedup_latest, in_window
from callsight.operators.quantiles import percentiles

LATENCIES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
P95 = {"p95": 0.95}


def requests() -> Column:
    return F.count(F.lit(1))


def errors() -> Column:
    """Failed calls; cancelled ones are not failures."""
    return F.count_if(F.col("status") == "error")


def tokens(kind: str = "total") -> Column:
    return F.sum(f"{kind}_tokens")


def cost() -> Column:
    """Sum of the reported costs; null when none was reported. Decimals add up to the same
    sum in any order."""
    return F.sum(F.col("cost_usd").cast("decimal(38,12)")).cast("double")


def totals(logs: DataFrame, mode: str = "exact") -> DataFrame:
    """One row, also when there are no logs."""
    raw = percentiles(mode)(
        logs,
        [],
        "latency_ms",
        LATENCIES,
        sums={
            "requests": requests(),
            "errors": errors(),
            "tokens": tokens(),
            "cost": cost(),
            "ttft": F.sum("ttft_ms"),
            "ttft_calls": F.count("ttft_ms"),
        },
    )
    return raw.select(*_totals_columns())


def _totals_columns() -> list[Column]:
    return [
        zero_int(F.col("requests")).alias("requests"),
        zero_int(F.col("errors")).alias("errors"),
        error_rate(F.col("errors"), F.col("requests")).alias("error_rate"),
        zero_int(round_even(F.col("p50"))).alias("p50_ms"),
        zero_int(round_even(F.col("p95"))).alias("p95_ms"),
        zero_int(round_even(F.col("p99"))).alias("p99_ms"),
        zero_int(round_even(F.try_divide("ttft", "ttft_calls"))).alias("avg_ttft_ms"),
        zero_int(F.col("tokens")).alias("total_tokens"),
        zero_float(round_even(F.col("cost"), 4)).alias("total_cost_usd"),
    ]


def timeseries(logs: DataFrame, bucket_seconds: int, mode: str = "exact") -> DataFrame:
    """Per bucket, oldest first. Buckets without calls are left out."""
    raw = percentiles(mode)(
        logs.withColumn("t", bucket_start(F.col("created_at"), bucket_seconds)),
        ["t"],
        "latency_ms",
        P95,
        sums={"requests": requests(), "errors": errors()},
    )
    return raw.select("t", "requests", "errors", zero_int(round_even(F.col("p95"))).alias("p95_ms")).orderBy("t")


def by_provider(logs: DataFrame, mode: str = "exact") -> DataFrame:
    """Busiest provider first, ties by name."""
    raw = percentiles(mode)(
        logs,
        ["provider"],
        "latency_ms",
        P95,
        sums={"requests": requests(), "errors": errors(), "tokens": tokens(), "cost": cost()},
    )
    return raw.select(
        "provider",
        "requests",
        zero_int(round_even(F.col("p95"))).alias("p95_ms"),
        "errors",
        zero_int(F.col("tokens")).alias("tokens"),
        zero_float(round_even(F.col("cost"), 4)).alias("cost_usd"),
    ).orderBy(F.desc("requests"), "provider")


def by_model(logs: DataFrame, mode: str = "exact") -> DataFrame:
    """Busiest model first, ties by name."""
    raw = percentiles(mode)(
        logs,
        ["model"],
        "latency_ms",
        P95,
        sums={"requests": requests(), "errors": errors(), "tokens": tokens()},
    )
    return raw.select(
        "model",
        "requests",
        zero_int(round_even(F.col("p95"))).alias("p95_ms"),
        "errors",
        zero_int(F.col("tokens")).alias("tokens"),
    ).orderBy(F.desc("requests"), "model")


PART = ["section", "t", "name"]
SECTIONS = ["totals", "timeseries", "by_provider", "by_model"]  # in the order of SETS
SETS = [[], ["t"], ["provider"], ["model"]]


def summary(logs: DataFrame, window: str, as_of: Time, dedup: bool = True, mode: str = "exact") -> DataFrame:
    """All four parts in one pass, one row per part and group.

    `section` is totals, timeseries, by_provider or by_model; `t` and `name` hold the
    group. Only totals are there when the window is empty, as zeros.
    """
    rows = in_window(logs, window, as_of)
    buckets = (dedup_latest(rows) if dedup else rows).withColumn(
        "t", bucket_start(F.col("created_at"), window_bucket(window))
    )
    raw = percentiles(mode)(
        buckets,
        ["t", "provider", "model"],
        "latency_ms",
        LATENCIES,
        sums={
            "requests": requests(),
            "errors": errors(),
            "tokens": tokens(),
            "cost": cost(),
            "ttft": F.sum("ttft_ms"),
            "ttft_calls": F.count("ttft_ms"),
        },
        sets=SETS,
    )
    return in_sections(raw)


def in_sections(raw: DataFrame) -> DataFrame:
    """The rows of the summary from counts by `SETS`."""
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("set") + 1)
    found = raw.select(
        section.alias("section"), "t", F.coalesce("provider", "model").alias("name"), *_totals_columns()
    )
    zeros = empty_totals(raw.sparkSession).selectExpr(
        "'totals' as section", "cast(null as timestamp) as t", "cast(null as string) as name", "*"
    )
    measured = [c for c in found.columns if c not in PART]
    # The zero row adds nothing to a totals row and stands for it where there is none.
    return (
        found.unionByName(zeros)
        .groupBy(*PART)
        .agg(*[F.max(c).alias(c) for c in measured])
    )


def empty_totals(spark: SparkSession) -> DataFrame:
    whole_numbers = ["requests", "errors", "p50_ms", "p95_ms", "p99_ms", "avg_ttft_ms", "total_tokens"]
    zero = {c: F.lit(0).cast("bigint") for c in whole_numbers}
    zero |= {"error_rate": F.lit(0.0), "total_cost_usd": F.lit(0.0)}
    order = ["requests", "errors", "error_rate", "p50_ms", "p95_ms", "p99_ms", "avg_ttft_ms"]
    return spark.range(1).select(*[zero[c].alias(c) for c in [*order, "total_tokens", "total_cost_usd"]])


def summary_struct(found: DataFrame, window: str) -> DataFrame:
    """The nested answer of the API as one row, from the rows of `summary`.

    It holds one entry per bucket, provider and model of the window, already counted.
    """

    def entries(section: str, order: list[Column], entry: Column) -> Column:
        kept = F.collect_list(
            F.when(F.col("section") == section, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], entry.alias("e")))
        )
        return F.transform(F.array_sort(kept), lambda x: x["e"])

    busiest = [-F.col("requests"), F.col("name")]
    return found.agg(
        F.lit(window).alias("window"),
        F.lit(None).cast("string").alias("error"),
        F.max(
            F.when(
                F.col("section") == "totals",
                F.struct(
                    "requests", "error_rate", "p50_ms", "p95_ms", "p99_ms", "avg_ttft_ms", "total_tokens", "total_cost_usd"
                ),
            )
        ).alias("totals"),
        entries(
            "timeseries", [F.col("t")], F.struct(iso_text(F.col("t")).alias("t"), "requests", "errors", "p95_ms")
        ).alias("timeseries"),
        entries(
            "by_provider",
            busiest,
            F.struct(
                F.col("name").alias("provider"),
                "requests",
                "p95_ms",
                "errors",
                F.col("total_tokens").alias("tokens"),
                F.col("total_cost_usd").alias("cost_usd"),
            ),
        ).alias("by_provider"),
        entries(
            "by_model",
            busiest,
            F.struct(
                F.col("name").alias("model"), "requests", "p95_ms", "errors", F.col("total_tokens").alias("tokens")
            ),
        ).alias("by_model"),
    )


def empty_summary(spark: SparkSession, window: str, error: str | None = None) -> DataFrame:
    """The nested answer with zeros and the reason, for when the logs cannot be read."""
    zeros = empty_totals(spark).withColumn("section", F.lit("totals"))
    zeros = zeros.withColumns({"t": F.lit(None).cast("timestamp"), "name": F.lit(None).cast("string")})
    return summary_struct(zeros, window).withColumn("error", F.lit(error).cast("string"))


def summary_or_empty(
    spark: SparkSession, read: Callable[[], DataFrame], window: str, as_of: Time, dedup: bool = True
) -> DataFrame:
    """The nested answer; when the log table cannot be opened or read, the empty one with the
    reason. It is worked out here: one row, already counted."""
    window_bucket(window)
    try:
        found = summary_struct(summary(read(), window, as_of, dedup), window)
        return spark.createDataFrame(found.collect(), found.schema)
    except Exception as exc:  # the report page never fails because of the store
        return empty_summary(spark, window, str(exc))


def pipeline_lag(logs: DataFrame, bucket_seconds: int, mode: str = "exact") -> DataFrame:
    """How long after the call its row was stored, per bucket of the call's time."""
    lagged = logs.withColumns(
        {
            "t": bucket_start(F.col("created_at"), bucket_seconds),
            "lag_ms": millis_between(F.col("created_at"), F.col("ingested_at")),
        }
    )
    raw = percentiles(mode)(
        lagged, ["t"], "lag_ms", {**P95, "worst": 1.0}, sums={"requests": requests(), "lag": F.sum("lag_ms")}
    )
    return raw.select(
        "t",
        "requests",
        whole(F.col("lag") / F.col("requests")).alias("avg_lag_ms"),
        whole(F.col("p95")).alias("p95_lag_ms"),
        whole(F.col("worst")).alias("max_lag_ms"),
    )


def share_of_peak(series: DataFrame) -> DataFrame:
    """Bar heights of a time series: percent of the busiest bucket, and the failed part of it."""
    # The series is already counted: one row per bucket meets here, not the calls.
    peak = F.greatest(F.max("requests").over(Window.partitionBy(F.lit(1))), F.lit(1))
    height = F.floor(F.col("requests") / peak * 100 + 0.5)
    return series.withColumn("height", height).withColumn(
        "error_height",
        F.when(F.col("requests") > 0, F.floor(F.col("errors") / F.col("requests") * F.col("height") + 0.5)).otherwise(0),
    )


def last_not_null(series: DataFrame, value: str, time: str = "t") -> DataFrame:
    """A single-value panel shows the last reading of its series."""
    return series.agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(time))).alias(value))
