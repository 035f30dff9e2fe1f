"""Stored sketches: what a summary reads, what a day's second making leaves, how near the percentiles are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from callsight.operators.quantiles import exact_percentiles
from callsight.plans import metrics, rollups
from callsight.sources import logs

AS_OF = "2024-01-07 22:00:00"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rollups")
    rows = spark.range(0, 120_000, 1, 6).selectExpr(
        "concat('r', id) as request_id", "'s' as session_id", "'c' as conversation_id",
        "if(id % 3 = 0, 'hot', concat('p', id % 5)) as provider", "concat('m', id % 4) as model",
        "if(id % 11 = 0, 'error', 'success') as status", "'' as error_type", "'' as error_message",
        "exp(pmod(xxhash64(id), 1000000) / 150000D) as latency_ms", "if(id % 2 = 0, id % 300D, null) as ttft_ms",
        "id % 10 as prompt_tokens", "id % 7 as completion_tokens", "id % 17 as total_tokens", "if(id % 5 = 0, null, 0.1D) as cost_usd",
        "'' as input_preview", "'' as output_preview", "0 as redacted",
        "timestamp_seconds(1704067200 + id * 5) as created_at", "'{}' as metadata",
    )
    logs.write_logs(rows, f"{folder}/logs", "one", "2024-01-31")
    logs.write_logs(rows.where("id % 9 = 0"), f"{folder}/logs", "copies", "2024-01-31 01:00:00")
    days = logs.stored_days(spark, f"{folder}/logs")
    rollups.write_rollups(spark, f"{folder}/logs", f"{folder}/rollups", days)
    return str(folder), days


def test_a_summary_reads_the_rollups_alone(spark, stored):
    folder, _ = stored
    found = rollups.summary_from_rollups(rollups.read_rollups(spark, f"{folder}/rollups"), "24h", AS_OF)
    files = found.inputFiles()
    assert files and all("/rollups/day=" in f for f in files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("window", ["1h", "24h", "7d"])
def test_sums_are_exact_and_ranks_near(spark, stored, window):
    folder, _ = stored
    table = rollups.read_rollups(spark, f"{folder}/rollups")
    rows = logs.read_latest(spark, f"{folder}/logs")
    exact = {(r.section, r["name"]): r for r in metrics.summary(rows, window, AS_OF, dedup=False).collect() if r.section != "timeseries"}
    found = [r for r in rollups.summary_from_rollups(table, window, AS_OF).collect() if r.section != "timeseries"]
    assert len(found) == len(exact) > 8
    for r in found:
        want = exact[r.section, r["name"]]
        for column in ("requests", "errors", "error_rate", "avg_ttft_ms", "total_tokens", "total_cost_usd"):
            assert r[column] == want[column], column
    groups = rollups.window_groups(table, window, AS_OF).where("set = 2").collect()
    probs = {f"{n}_{side}": min(max(p + s * rollups.RANK_ERROR, 0), 1) for n, p in metrics.LATENCIES.items() for s, side in ((-1, "low"), (1, "high"))}
    since = {"1h": 1, "24h": 24, "7d": 168}[window]
    near = exact_percentiles(rows.where(F.col("created_at") >= F.expr(f"timestamp'{AS_OF}' - interval {since} hours")), ["provider"], "latency_ms", probs)
    near = {r.provider: r for r in near.collect()}
    for r in groups:
        for name in metrics.LATENCIES:
            low, high = near[r.provider][f"{name}_low"], near[r.provider][f"{name}_high"]
            assert low * 0.97 <= r[name] <= high * 1.03 if r.requests < 2000 else low <= r[name] <= high


def test_a_day_that_is_made_again_is_replaced(spark, stored):
    folder, days = stored
    rows = lambda: sorted(map(tuple, rollups.read_rollups(spark, f"{folder}/rollups").drop("latencies").collect()), key=repr)
    want = rows()
    rollups.write_rollups(spark, f"{folder}/logs", f"{folder}/rollups", days[2:4])
    rollups.write_rollups(spark, f"{folder}/logs", f"{folder}/rollups", [])
    assert rows() == want
    assert sum(r[3] for r in want) == 120_000


def test_rollups_of_nothing(spark, stored):
    folder, _ = stored
    late = rollups.summary_from_rollups(rollups.read_rollups(spark, f"{folder}/rollups"), "1h", "2030-01-01 00:00:00")
    assert [(r.section, r.requests, r.p95_ms) for r in late.collect()] == [("totals", 0, 0)]
    one = rollups.read_rollups(spark, f"{folder}/rollups", dt.datetime(2024, 1, 2, 12))
    assert one.agg(F.min("t")).first()[0] == dt.datetime(2024, 1, 2, 12)
