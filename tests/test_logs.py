"""Log operators, metrics identities, the stored table."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from callsight.operators import logs as ops
from callsight.plans import metrics, panels
from callsight.sources import logs as table
from checks import inputs


@pytest.fixture(scope="module")
def raw(spark, sf):
    return inputs.raw_logs(spark, sf).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_is_idempotent_and_free_of_order(raw):
    once = ops.dedup_latest(raw)
    assert rows(ops.dedup_latest(once)) == rows(once)
    assert rows(ops.dedup_latest(raw.orderBy(F.desc("latency_ms")))) == rows(once)
    assert once.count() == raw.select("request_id").distinct().count()


def test_many_copies_of_one_call(spark):
    copies = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) as request_id", "id as ingested_at"
    )
    kept = ops.dedup_latest(copies, ["request_id"])
    assert kept.count() == 20001 and kept.where("request_id = 'hot'").first().ingested_at == 29997


def test_windows(raw):
    with pytest.raises(ValueError):
        ops.in_window(raw, "2h", inputs.AS_OF)
    future = raw.limit(1).withColumn("created_at", F.lit("2031-01-01").cast("timestamp"))
    assert ops.in_window(future, "1h", inputs.AS_OF).count() == 1  # no upper bound
    assert ops.in_range(future, *inputs.RANGE).count() == 0
    edge = raw.limit(1).withColumn("created_at", F.lit("2024-01-30 23:00:00").cast("timestamp"))
    assert ops.in_window(edge, "1h", inputs.AS_OF).count() == 1
    assert ops.last_hours(edge, 6, inputs.AS_OF).count() == 1


@pytest.mark.parametrize(
    "created,kept",
    [("2024-01-01 00:00:00.999", False), ("2024-01-01 00:00:01.000", True), ("2024-01-01 00:00:00.000", False)],
)
def test_retention_is_to_the_second(spark, created, kept):
    row = spark.createDataFrame([(created,)], "created_at string").select(F.col("created_at").cast("timestamp"))
    assert ops.retain(row, "2024-03-31 00:00:00").count() == int(kept)


def test_parts_add_up(raw):
    found = metrics.summary(raw, "7d", inputs.AS_OF).collect()
    total = next(r for r in found if r.section == "totals")
    for section in ("timeseries", "by_provider", "by_model"):
        part = [r for r in found if r.section == section]
        for measure in ("requests", "errors", "total_tokens"):
            assert sum(r[measure] for r in part) == total[measure]


def test_summary_equals_its_parts(raw):
    logs = ops.dedup_latest(ops.in_window(raw, "24h", inputs.AS_OF))
    found = metrics.summary(raw, "24h", inputs.AS_OF).cache()
    alone = metrics.totals(logs).first().asDict()
    assert found.where("section = 'totals'").select(*alone).first().asDict() == alone
    series = found.where("section = 'timeseries'").select("t", "requests", "errors", "p95_ms").orderBy("t")
    assert series.collect() == metrics.timeseries(logs, 1800).collect()


def test_empty_window(spark, raw):
    found = metrics.summary(raw, "1h", "2030-01-01").collect()
    assert [(r.section, r.requests, r.error_rate, r.total_cost_usd) for r in found] == [("totals", 0, 0.0, 0.0)]
    nested = metrics.summary_struct(metrics.summary(raw, "1h", "2030-01-01"), "1h").first()
    empty = metrics.empty_summary(spark, "1h", "unreachable").first()
    assert nested.totals == empty.totals and empty.totals.requests == 0 and empty.totals.total_cost_usd == 0.0
    assert (nested.timeseries, nested.by_provider, nested.by_model) == ([], [], [])
    assert (empty.window, empty.error) == ("1h", "unreachable") and nested.error is None


def test_summary_without_a_store(spark):
    read = lambda: spark.read.parquet("/nowhere/at/all")
    found = metrics.summary_or_empty(spark, read, "24h", inputs.AS_OF).first()
    assert found.totals.requests == 0 and "nowhere" in found.error
    with pytest.raises(ValueError):
        metrics.summary_or_empty(spark, read, "2h", inputs.AS_OF)


def test_panels_on_no_rows(raw):
    none = raw.where("1 = 0")
    assert panels.stat_requests(none).first().requests == 0
    assert panels.stat_error_rate(none).first().error_rate == 0.0
    assert panels.stat_p95(none).first().p95_ms is None and panels.stat_tokens(none).first().tokens is None
    for panel in (panels.by_provider, panels.tokens_by_model, panels.cost_by_provider):
        assert panel(none).collect() == []
    for panel in (panels.latency_percentiles, panels.throughput, panels.error_rate_over_time, panels.ttft_p95):
        assert panel(none, 60).collect() == []
    assert metrics.share_of_peak(metrics.timeseries(none, 60)).collect() == []


def test_orders(raw):
    models = panels.tokens_by_model(raw).collect()
    assert models == sorted(models, key=lambda r: (-r.total, r.model))
    costs = [r.cost_usd for r in panels.cost_by_provider(raw).collect()]
    assert costs[-1] is None and costs[:-1] == sorted(costs[:-1], reverse=True)
    times = [r.time for r in panels.throughput(raw, 3600).collect()]
    assert times == sorted(times)


# --- storage ---------------------------------------------------------------------------


def days_of(path):
    return sorted(n for n in os.listdir(path) if n.startswith("day="))


def test_a_batch_written_twice_counts_once(spark, raw, tmp_path):
    path = str(tmp_path / "logs")
    for _ in range(2):
        table.write_logs(raw, path, "7")
    assert table.read_logs(spark, path).count() == raw.count()
    table.write_logs(raw, path, "8")
    assert table.read_logs(spark, path).count() == 2 * raw.count()
    assert table.read_latest(spark, path).count() == ops.dedup_latest(raw).count()


def test_compaction(spark, raw, tmp_path):
    path = str(tmp_path / "logs")
    table.write_logs(raw, path, "1", "2024-02-01")
    table.write_logs(raw, path, "2", "2024-02-02")
    days = table.stored_days(spark, path)
    before = rows(ops.dedup_latest(table.read_logs(spark, path)).drop("batch"))
    running = table.read_latest(spark, path)  # has planned to read the old batches
    table.compact_days(spark, path, days[:3])
    assert rows(running) == rows(table.read_latest(spark, path)) == before
    assert table.remove_replaced(spark, path) == 0  # too young
    assert table.remove_replaced(spark, path, dt.timedelta(0)) == 6
    assert all(len([b for b in os.listdir(f"{path}/day={d}") if b.startswith("batch=")]) == 1 for d in days[:3])
    assert rows(ops.dedup_latest(table.read_logs(spark, path)).drop("batch")) == before
    assert rows(table.read_latest(spark, path)) == before
    settled = table.read_logs(spark, path).where(F.col("day").isin(days[:3]))
    assert settled.count() == ops.dedup_latest(settled).count()
    table.compact_days(spark, path, [dt.date(2031, 1, 1)])  # nothing there


def test_late_row_reaches_its_own_day(spark, raw, tmp_path):
    path = str(tmp_path / "logs")
    table.write_logs(raw, path, "1")
    table.compact_days(spark, path, table.stored_days(spark, path), file_bytes=5_000)
    table.remove_replaced(spark, path, dt.timedelta(0))
    late = raw.limit(1).withColumn("request_id", F.lit("late"))
    table.write_logs(late, path, "2")
    assert table.read_latest(spark, path).count() == ops.dedup_latest(raw).count() + 1


def test_expiry_drops_whole_days(spark, raw, tmp_path):
    path = str(tmp_path / "logs")
    table.write_logs(raw, path, "1")
    gone = table.drop_expired(spark, path, dt.datetime(2024, 4, 10, 12))
    assert gone and max(gone) == dt.date(2024, 1, 10)
    assert days_of(path)[0] == "day=2024-01-11"
    assert table.drop_expired(spark, path, dt.datetime(2024, 4, 10, 12)) == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_prunes_days_and_columns(spark, raw, tmp_path):
    path = str(tmp_path / "logs")
    table.write_logs(raw, path, "1")
    logs = ops.dedup_latest(ops.in_window(table.read_logs(spark, path), "24h", inputs.AS_OF))
    text = plan(logs.groupBy("provider").agg(F.sum("total_tokens")))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(day" in scan and "day#" in scan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(created_at" in scan
    assert "input_preview" not in scan and "metadata" not in scan
    assert "WindowGroupLimit" in text


def scanned(df):
    """Rows that the file scans of a query have read, after row groups were passed over."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        if plan.nodeName().endswith("QueryStage"):
            plan = plan.plan()
        if plan.nodeName().startswith("Scan parquet"):
            found += plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def many_logs(spark, path, n=60_000, days=3):
    rows = spark.range(0, n, 1, 4).selectExpr(
        "concat('r', xxhash64(id)) as request_id", "'s' as session_id", "'c' as conversation_id", "'p' as provider", "'m' as model",
        "'success' as status", "'' as error_type", "'' as error_message", "1D as latency_ms", "1D as ttft_ms", "1L as prompt_tokens",
        "1L as completion_tokens", "2L as total_tokens", "0D as cost_usd", "'' as input_preview", "'' as output_preview", "0 as redacted",
        f"timestamp_seconds(1704067200 + id * {days} * 86400 div {n}) as created_at", "'{}' as metadata",
    )
    table.write_logs(rows, path, "one", "2024-02-01")
    return [r.request_id for r in rows.where("id % 3000 = 0").collect()]


def test_a_lookup_of_some_ids_reads_a_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "logs")
    ids = many_logs(spark, path)
    assert len(ids) == 20
    spark.conf.set("parquet.block.size", "65536")
    try:
        hadoop = spark._jsc.hadoopConfiguration()
        hadoop.set("parquet.block.size", "65536")
        table.compact_days(spark, path, table.stored_days(spark, path))
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    table.remove_replaced(spark, path, dt.timedelta(0))
    found = table.read_requests(spark, path, [*ids, "r0", ids[0]])
    assert sorted(r.request_id for r in found.collect()) == sorted(ids)
    assert scanned(found) < 0.5 * 60_000 == 0.5 * scanned(table.read_logs(spark, path))
    none = table.read_requests(spark, path, ["r0"])
    assert scanned(none) < 0.1 * 60_000 and table.read_requests(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        table.read_requests(spark, path, [f"r{i}" for i in range(201)])


def test_a_read_of_some_days_lists_their_files_alone(spark, tmp_path):
    path = str(tmp_path / "logs")
    many_logs(spark, path, 3000)
    table.compact_days(spark, path, table.stored_days(spark, path)[:2])
    some = table.read_latest(spark, path, since="2024-01-02 00:00:00", until="2024-01-02 23:59:59")
    files = some.inputFiles()
    assert files and all("/day=2024-01-02/" in f for f in files) and some.count() == 1000
    assert table.read_latest(spark, path, since="2030-01-01").count() == 0
    assert table.read_latest(spark, path).count() == 3000


def test_a_file_of_a_compacted_day_stays_small_enough_to_be_sorted(spark, tmp_path, monkeypatch):
    ranges = []
    monkeypatch.setattr(table, "_bytes", lambda spark, path: 256 << 20)
    monkeypatch.setattr(table, "_save", lambda rows, *args: ranges.append(
        int(re.search(r"RepartitionByExpression .*\], (\d+)", rows._jdf.queryExecution().analyzed().toString())[1])))
    (tmp_path / "day=2024-01-01" / "batch=a").mkdir(parents=True)
    table.compact_days(spark, str(tmp_path), [dt.date(2024, 1, 1)])
    assert ranges[0] >= 8
