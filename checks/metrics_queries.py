"""Log table, metrics summary and dashboard panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from callsight.functions.times import WINDOWS, bucket_start, iso_millis, iso_text
from callsight.operators import logs as ops
from callsight.operators.quantiles import in_sets
from callsight.plans import metrics, panels, rollups
from callsight.session import scratch_path
from callsight.sources import logs as log_table
from checks import inputs
from checks.inputs import AS_OF, RANGE
from checks.sql import EVENTS, iso, quantile, rounded, whole, window, zero

QUERIES, SQL = {}, {}
HOUR = 3600


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def times_as_text(df):
    """Times in the answers are compared as text."""
    return df.select(
        *[iso_millis(F.col(f.name)).alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.col(f.name) for f in df.schema]
    )


def settled(spark, sf_dir, window_name=None):
    """Logs of a window without copies."""
    rows = inputs.raw_logs(spark, sf_dir)
    return ops.dedup_latest(ops.in_window(rows, window_name, AS_OF) if window_name else rows)


def in_range(spark, sf_dir):
    return ops.dedup_latest(ops.in_range(inputs.raw_logs(spark, sf_dir), *RANGE))


IN_RANGE = f"(SELECT * FROM logs WHERE created_at BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}')"

# --- the log table -------------------------------------------------------------------

LOG_FIELDS = ["request_id", "session_id", "conversation_id", "provider", "model", "status", "latency_ms", "ttft_ms",
              "total_tokens", "cost_usd", "created_at", "ingested_at"]
LOG_SQL = ", ".join(f"{iso(c)} AS {c}" if c.endswith("_at") else c for c in LOG_FIELDS)


def log_rows(df):
    return times_as_text(df.select(*LOG_FIELDS))


register(
    "logs_dedup_latest",
    lambda s, d: log_rows(settled(s, d)),
    f"WITH {EVENTS} SELECT {LOG_SQL} FROM logs",
)
register(
    "logs_raw_window",
    lambda s, d: log_rows(ops.in_window(inputs.raw_logs(s, d), "24h", AS_OF)),
    f"WITH {EVENTS} SELECT {LOG_SQL} FROM {window(24, 'raw_logs')}",
)
register(
    "logs_range",
    lambda s, d: log_rows(in_range(s, d)),
    f"WITH {EVENTS} SELECT {LOG_SQL} FROM {IN_RANGE}",
)
register(
    "logs_retained",
    lambda s, d: log_rows(ops.retain(settled(s, d), "2024-04-15 10:20:30.5")),
    f"""WITH {EVENTS} SELECT {LOG_SQL} FROM logs
    WHERE date_trunc('second', created_at) + INTERVAL 90 DAY > TIMESTAMP '2024-04-15 10:20:30.5'""",
)

# --- the summary ---------------------------------------------------------------------

TOTALS = f"""
  count(*) AS requests, count(*) FILTER (status = 'error') AS errors,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST({rounded("100.0 * count(*) FILTER (status = 'error') / count(*)", 2)} AS DOUBLE) END AS error_rate,
  {zero(quantile(0.5))} AS p50_ms, {zero(quantile(0.95))} AS p95_ms, {zero(quantile(0.99))} AS p99_ms,
  {zero('avg(ttft_ms)')} AS avg_ttft_ms, CAST(COALESCE(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
  COALESCE({rounded('sum(cost_usd)', 4)}, 0.0) AS total_cost_usd"""
for name, (hours, bucket) in WINDOWS.items():
    register(
        f"metrics_totals_{name}",
        lambda s, d, w=name: metrics.totals(settled(s, d, w)),
        f"WITH {EVENTS} SELECT {TOTALS} FROM {window(hours)}",
    )
    register(
        f"metrics_timeseries_{name}",
        lambda s, d, w=name, b=bucket: times_as_text(metrics.timeseries(settled(s, d, w), b)),
        f"""WITH {EVENTS} SELECT {iso(f"time_bucket(INTERVAL {bucket} SECOND, created_at, TIMESTAMP '1970-01-01')")} AS t,
        count(*) AS requests, count(*) FILTER (status = 'error') AS errors, {zero(quantile(0.95))} AS p95_ms
        FROM {window(hours)} GROUP BY 1""",
    )
register(
    "metrics_by_provider_7d",
    lambda s, d: metrics.by_provider(settled(s, d, "7d")),
    f"""WITH {EVENTS} SELECT provider, count(*) AS requests, {zero(quantile(0.95))} AS p95_ms,
    count(*) FILTER (status = 'error') AS errors, CAST(sum(total_tokens) AS BIGINT) AS tokens,
    COALESCE({rounded('sum(cost_usd)', 4)}, 0.0) AS cost_usd FROM {window(168)} GROUP BY provider""",
)
register(
    "metrics_by_model_7d",
    lambda s, d: metrics.by_model(settled(s, d, "7d")),
    f"""WITH {EVENTS} SELECT model, count(*) AS requests, {zero(quantile(0.95))} AS p95_ms,
    count(*) FILTER (status = 'error') AS errors, CAST(sum(total_tokens) AS BIGINT) AS tokens
    FROM {window(168)} GROUP BY model""",
)
register(
    "metrics_empty",
    lambda s, d: metrics.totals(ops.in_window(inputs.raw_logs(s, d), "1h", "2030-01-01 00:00:00")),
    f"WITH {EVENTS} SELECT {TOTALS} FROM logs WHERE created_at >= TIMESTAMP '2029-12-31 23:00:00'",
)
_SUMMARY_SQL = f"""WITH {EVENTS}, rows AS {window(168)}, parts AS (
  SELECT 'totals' AS section, NULL AS t, NULL AS name, * FROM rows
  UNION ALL SELECT 'timeseries', {iso("time_bucket(INTERVAL 21600 SECOND, created_at, TIMESTAMP '1970-01-01')")}, NULL, * FROM rows
  UNION ALL SELECT 'by_provider', NULL, provider, * FROM rows
  UNION ALL SELECT 'by_model', NULL, model, * FROM rows)
SELECT section, t, name, {TOTALS} FROM parts GROUP BY section, t, name"""
register(
    "metrics_grouping_sets",
    lambda s, d: times_as_text(metrics.summary(inputs.raw_logs(s, d), "7d", AS_OF)),
    _SUMMARY_SQL,
)
register(
    "metrics_summary_struct",
    lambda s, d: metrics.summary_struct(metrics.summary(inputs.raw_logs(s, d), "7d", AS_OF), "7d").select(
        "window",
        "error",
        "totals.*",
        F.array_join(F.transform("timeseries", lambda x: F.concat_ws("|", x["t"], x["requests"], x["errors"], x["p95_ms"])), ",").alias("timeseries"),
        F.array_join(F.transform("by_provider", lambda x: F.concat_ws("|", x["provider"], x["requests"], x["p95_ms"], x["errors"], x["tokens"])), ",").alias("by_provider"),
        F.bround(F.aggregate("by_provider", F.lit(0.0), lambda a, x: a + x["cost_usd"]), 4).alias("cost_of_providers"),
        F.array_join(F.transform("by_model", lambda x: F.concat_ws("|", x["model"], x["requests"], x["p95_ms"], x["errors"], x["tokens"])), ",").alias("by_model"),
    ),
    f"""WITH {EVENTS}, rows AS {window(168)},
    ts AS (SELECT strftime(time_bucket(INTERVAL 21600 SECOND, created_at, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S') AS t,
      count(*) AS n, count(*) FILTER (status = 'error') AS e, {zero(quantile(0.95))} AS p FROM rows GROUP BY 1),
    pr AS (SELECT provider AS k, count(*) AS n, count(*) FILTER (status = 'error') AS e, {zero(quantile(0.95))} AS p,
      CAST(sum(total_tokens) AS BIGINT) AS tok, COALESCE({rounded('sum(cost_usd)', 4)}, 0.0) AS cost FROM rows GROUP BY 1),
    mo AS (SELECT model AS k, count(*) AS n, count(*) FILTER (status = 'error') AS e, {zero(quantile(0.95))} AS p,
      CAST(sum(total_tokens) AS BIGINT) AS tok FROM rows GROUP BY 1)
    SELECT '7d' AS "window", CAST(NULL AS VARCHAR) AS error, tot.* EXCLUDE (errors),
      {rounded('(SELECT sum(cost) FROM pr)', 4)} AS cost_of_providers,
      (SELECT string_agg(concat_ws('|', t, n, e, p), ',' ORDER BY t) FROM ts) AS timeseries,
      (SELECT string_agg(concat_ws('|', k, n, p, e, tok), ',' ORDER BY n DESC, k) FROM pr) AS by_provider,
      (SELECT string_agg(concat_ws('|', k, n, p, e, tok), ',' ORDER BY n DESC, k) FROM mo) AS by_model
    FROM (SELECT {TOTALS} FROM rows) AS tot""",
)
register(
    "metrics_percentiles_approx",
    lambda s, d: metrics.by_model(settled(s, d), mode="approx"),
    f"""WITH {EVENTS} SELECT model, count(*) AS requests, {zero("quantile_disc(latency_ms, 0.95)")} AS p95_ms,
    count(*) FILTER (status = 'error') AS errors, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM logs GROUP BY model""",
)


def sketch(spark, sf_dir):
    """Whether the sketch's p95 has a rank within two percent of the wanted one."""
    rows = settled(spark, sf_dir)
    near = rows.groupBy("provider").agg(F.percentile("latency_ms", F.array(F.lit(0.93), F.lit(0.97))).alias("near"))
    within = F.col("p95_ms").between(F.floor(F.col("near")[0]), F.ceil(F.col("near")[1]))
    found = metrics.by_provider(rows, mode="sketch").join(near, "provider")
    return found.select("provider", "requests", "errors", "tokens", within.alias("within"))


register(
    "metrics_percentiles_sketch",
    sketch,
    f"""WITH {EVENTS} SELECT provider, count(*) AS requests, count(*) FILTER (status = 'error') AS errors,
    CAST(sum(total_tokens) AS BIGINT) AS tokens, true AS within FROM logs GROUP BY provider""",
)


def unreachable(spark, sf_dir):
    """The answer when the store fails while it is read."""
    fails = F.raise_error(F.lit("store is down")).cast("double")
    read = lambda: inputs.raw_logs(spark, sf_dir).withColumn("latency_ms", F.coalesce(fails, "latency_ms"))
    found = metrics.summary_or_empty(spark, read, "7d", AS_OF)
    return found.select(
        "window",
        F.col("error").contains("store is down").alias("told"),
        "totals.*",
        (F.size("timeseries") + F.size("by_provider") + F.size("by_model")).alias("entries"),
    )


register(
    "summary_unreachable",
    unreachable,
    f"""WITH {EVENTS} SELECT '7d' AS "window", true AS told, t.* EXCLUDE (errors), 0 AS entries
    FROM (SELECT {TOTALS} FROM logs WHERE created_at > TIMESTAMP '2100-01-01') AS t""",
)
register(
    "logs_last_6h",
    lambda s, d: ops.last_hours(inputs.raw_logs(s, d), 6, "2024-01-30 12:00:00").groupBy("provider").agg(
        metrics.requests().alias("requests")
    ),
    f"""WITH {EVENTS} SELECT provider, count(*) AS requests FROM raw_logs
    WHERE created_at BETWEEN TIMESTAMP '2024-01-30 06:00:00' AND TIMESTAMP '2024-01-30 12:00:00' GROUP BY provider""",
)

# --- the panels ----------------------------------------------------------------------

BY_HOUR = iso("time_bucket(INTERVAL 3600 SECOND, created_at, TIMESTAMP '1970-01-01')")
PANEL_RATE = rounded("100.0 * count(*) FILTER (status = 'error') / greatest(count(*), 1)", 2)

register("panel_requests", lambda s, d: panels.stat_requests(in_range(s, d)),
         f"WITH {EVENTS} SELECT count(*) AS requests FROM {IN_RANGE}")
register("panel_error_rate", lambda s, d: panels.stat_error_rate(in_range(s, d)),
         f"WITH {EVENTS} SELECT CAST({PANEL_RATE} AS DOUBLE) AS error_rate FROM {IN_RANGE}")
register("panel_p95", lambda s, d: panels.stat_p95(in_range(s, d)),
         f"WITH {EVENTS} SELECT {whole(quantile(0.95))} AS p95_ms FROM {IN_RANGE}")
register("panel_tokens", lambda s, d: panels.stat_tokens(in_range(s, d)),
         f"WITH {EVENTS} SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens FROM {IN_RANGE}")
# The SQL engine interpolates with one fused multiply-add, Spark with two roundings: the
# last binary digit can differ, so these unrounded readings are compared to 6 decimals.
register(
    "panel_latency_percentiles",
    lambda s, d: times_as_text(
        panels.latency_percentiles(in_range(s, d), HOUR).select(
            "time", *[F.bround(p, 6).alias(p) for p in ("p50", "p95", "p99")]
        )
    ),
    f"""WITH {EVENTS} SELECT {BY_HOUR} AS time, {rounded(quantile(0.5), 6)} AS p50, {rounded(quantile(0.95), 6)} AS p95,
      {rounded(quantile(0.99), 6)} AS p99
    FROM {IN_RANGE} GROUP BY 1""",
)
register("panel_throughput", lambda s, d: times_as_text(panels.throughput(in_range(s, d), HOUR)),
         f"WITH {EVENTS} SELECT {BY_HOUR} AS time, count(*) AS requests FROM {IN_RANGE} GROUP BY 1")
register("panel_error_rate_ts", lambda s, d: times_as_text(panels.error_rate_over_time(in_range(s, d), HOUR)),
         f"WITH {EVENTS} SELECT {BY_HOUR} AS time, CAST({PANEL_RATE} AS DOUBLE) AS error_rate_pct FROM {IN_RANGE} GROUP BY 1")
register(
    "panel_ttft_p95",
    lambda s, d: times_as_text(panels.ttft_p95(in_range(s, d), HOUR)),
    f"""WITH {EVENTS} SELECT {BY_HOUR} AS time, {whole(quantile(0.95, 'ttft_ms'))} AS ttft_p95
    FROM {IN_RANGE} WHERE ttft_ms IS NOT NULL GROUP BY 1""",
)
register(
    "panel_by_provider",
    lambda s, d: panels.by_provider(in_range(s, d)),
    f"""WITH {EVENTS} SELECT provider, count(*) AS requests, {whole(quantile(0.95))} AS p95_ms,
    CAST(sum(total_tokens) AS BIGINT) AS tokens FROM {IN_RANGE} GROUP BY provider""",
)
register(
    "panel_tokens_by_model",
    lambda s, d: panels.tokens_by_model(in_range(s, d)),
    f"""WITH {EVENTS} SELECT model, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt,
    CAST(sum(completion_tokens) AS BIGINT) AS completion, CAST(sum(total_tokens) AS BIGINT) AS total
    FROM {IN_RANGE} GROUP BY model""",
)
register("panel_cost_by_provider", lambda s, d: panels.cost_by_provider(in_range(s, d)),
         f"WITH {EVENTS} SELECT provider, {rounded('sum(cost_usd)', 6)} AS cost_usd FROM {IN_RANGE} GROUP BY provider")

# --- what the page and the dashboard make of the answers --------------------------------

BY_HALF_DAY = iso("time_bucket(INTERVAL 43200 SECOND, created_at, TIMESTAMP '1970-01-01')")
register(
    "stat_last_not_null",
    lambda s, d: metrics.last_not_null(
        settled(s, d).groupBy(bucket_start(F.col("created_at"), 43200).alias("t")).agg(F.sum("ttft_ms").cast("bigint").alias("ttft")), "ttft"
    ),
    f"""WITH {EVENTS}, ts AS (SELECT {BY_HALF_DAY} AS t, CAST(trunc(sum(ttft_ms)) AS BIGINT) AS ttft FROM logs GROUP BY 1)
    SELECT ttft FROM ts WHERE ttft IS NOT NULL ORDER BY t DESC LIMIT 1""",
)
register(
    "share_of_peak",
    lambda s, d: times_as_text(
        metrics.share_of_peak(
            settled(s, d).groupBy(bucket_start(F.col("created_at"), 43200).alias("t")).agg(
                metrics.requests().alias("requests"), metrics.errors().alias("errors")
            )
        )
    ),
    f"""WITH {EVENTS}, ts AS (SELECT {BY_HALF_DAY} AS t, count(*) AS requests, count(*) FILTER (status = 'error') AS errors
      FROM logs GROUP BY 1),
    h AS (SELECT *, CAST(floor(requests / greatest((SELECT max(requests) FROM ts), 1) * 100 + 0.5) AS BIGINT) AS height FROM ts)
    SELECT *, CASE WHEN requests > 0 THEN CAST(floor(errors / requests * height + 0.5) AS BIGINT) ELSE 0 END AS error_height FROM h""",
)
register(
    "severity",
    lambda s, d: panels.alerts(
        settled(s, d)
        .withColumn("user", F.col("session_id"))
        .groupBy("user")
        .agg(
            panels.panel_error_rate(metrics.errors(), metrics.requests()).alias("error_rate"),
            F.bround(F.percentile("latency_ms", F.lit(0.95)) * 4, 6).alias("p95_ms"),
        )
    ),
    f"""WITH {EVENTS}, u AS (SELECT session_id AS "user", CAST({PANEL_RATE} AS DOUBLE) AS error_rate, {rounded(quantile(0.95) + ' * 4', 6)} AS p95_ms
      FROM logs GROUP BY 1)
    SELECT *, CASE WHEN error_rate >= 5 THEN 'red' WHEN error_rate >= 1 THEN 'yellow' ELSE 'green' END AS error_rate_level,
      CASE WHEN p95_ms >= 5000 THEN 'red' WHEN p95_ms >= 2000 THEN 'yellow' ELSE 'green' END AS p95_level FROM u""",
)
register(
    "pipeline_lag",
    lambda s, d: times_as_text(
        metrics.pipeline_lag(settled(s, d), 21600)
    ),
    f"""WITH {EVENTS}, lag AS (SELECT time_bucket(INTERVAL 21600 SECOND, created_at, TIMESTAMP '1970-01-01') AS t,
      date_diff('microsecond', created_at, ingested_at) / 1000 AS ms FROM logs)
    SELECT {iso('t')} AS t, count(*) AS requests, {whole('avg(ms)')} AS avg_lag_ms,
      {whole(quantile(0.95, 'ms'))} AS p95_lag_ms, {whole('max(ms)')} AS max_lag_ms FROM lag GROUP BY 1""",
)

# --- stored percentiles ------------------------------------------------------------------


def stored_rollups(spark, sf_dir):
    """Rollups of the log table, half of whose days are compacted; the last day is made twice."""
    path, out = scratch_path(spark, "logs"), scratch_path(spark, "rollups")
    log_table.write_logs(inputs.raw_logs(spark, sf_dir), path, "one")
    days = log_table.stored_days(spark, path)
    log_table.compact_days(spark, path, days[: len(days) // 2])
    rollups.write_rollups(spark, path, out, days)
    rollups.write_rollups(spark, path, out, days[-1:])
    return rollups.read_rollups(spark, out)


def near_ranks(spark, sf_dir, found, window_name):
    """Whether the rank of each percentile is within the stated error of the wanted one."""
    rows = settled(spark, sf_dir, window_name)
    bucket = bucket_start(F.col("created_at"), max(metrics.window_bucket(window_name), rollups.ROLLUP_SECONDS))
    keys = ["t", "provider", "model"]
    each, _ = in_sets(rows.withColumn("t", bucket).select(*keys, "latency_ms"), keys, metrics.SETS)
    by = ["set", *keys]
    points = found.select(*[F.col(c).alias(f"{c}_") for c in by], *metrics.LATENCIES)
    same = F.expr(" and ".join(f"{c} <=> {c}_" for c in by))
    n, error = F.count(F.lit(1)), rollups.RANK_ERROR
    within = [
        (F.count_if(F.col("latency_ms") < F.col(p)) <= n * (q + error)) & (F.count_if(F.col("latency_ms") <= F.col(p)) >= n * (q - error))
        for p, q in metrics.LATENCIES.items()
    ]
    return each.join(points, same).groupBy(*by).agg((within[0] & within[1] & within[2]).alias("within"))


def from_rollups(spark, sf_dir):
    table, parts = stored_rollups(spark, sf_dir), []
    for name in ("1h", "24h", "7d"):
        near = near_ranks(spark, sf_dir, rollups.window_groups(table, name, AS_OF), name)
        section = F.element_at(F.array(*map(F.lit, metrics.SECTIONS)), F.col("set") + 1)
        near = near.select(section.alias("s"), F.col("t").alias("at"), F.coalesce("provider", "model").alias("of"), "within")
        found = rollups.summary_from_rollups(table, name, AS_OF).drop("p50_ms", "p95_ms", "p99_ms")
        joined = found.join(near, F.expr("section <=> s and t <=> at and name <=> of"), "left")
        parts.append(joined.select(F.lit(name).alias("window"), *found.columns, F.coalesce("within", F.lit(True)).alias("within")))
    return times_as_text(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _rollup_sql(name, hours, bucket):
    start = f"(SELECT * FROM logs WHERE created_at >= date_trunc('hour', TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR))"
    t = iso(f"time_bucket(INTERVAL {bucket} SECOND, created_at, TIMESTAMP '1970-01-01')")
    return f"""SELECT '{name}' AS "window", section, t, name, {TOTALS}, true AS within FROM (
      SELECT 'totals' AS section, NULL AS t, NULL AS name, * FROM {start}
      UNION ALL SELECT 'timeseries', {t}, NULL, * FROM {start}
      UNION ALL SELECT 'by_provider', NULL, provider, * FROM {start}
      UNION ALL SELECT 'by_model', NULL, model, * FROM {start}) GROUP BY section, t, name"""


register(
    "summary_from_rollups",
    from_rollups,
    f"""WITH {EVENTS} SELECT * EXCLUDE (p50_ms, p95_ms, p99_ms) FROM (
    {" UNION ALL ".join(_rollup_sql(*w) for w in (("1h", 1, 3600), ("24h", 24, 3600), ("7d", 168, 21600)))})""",
)
