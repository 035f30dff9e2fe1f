"""The folded table of live metrics: files stay few, repeats change nothing, a new stream is newer."""

import glob

from pyspark.sql import functions as F

from callsight.streaming import live

DDL = "created_at timestamp, status string, latency_ms double, total_tokens bigint, cost_usd double"


def source(spark, path, files, day="2024-01-01"):
    for k in range(files):
        rows = spark.range(40).selectExpr(
            f"timestamp'{day} 00:00:00' + make_dt_interval(0, 0, {k * 30}, id * 10) as created_at",
            "if(id % 8 = 0, 'error', 'success') as status", "cast(id as double) as latency_ms", "id as total_tokens", "0.5D as cost_usd",
        )
        rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def kept(spark, stream, path, checkpoint, fold_every=4):
    live.keep_live_metrics(live.live_metrics(stream, 3600, "1 day"), path, checkpoint, fold_every=fold_every).awaitTermination()
    return sorted(map(tuple, live.read_live_metrics(spark, path).select("t", "requests", "errors", "p95_ms", "tokens", "cost_usd").collect()))


def batches(path):
    return glob.glob(f"{path}/day=*/batch=*")


def test_folders_are_bounded_and_repeats_change_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "live"), str(tmp_path / "rows")
    stream = source(spark, rows, 14)
    got = kept(spark, stream, path, str(tmp_path / "c"))
    want = spark.read.schema(DDL).parquet(rows).groupBy(F.window("created_at", "1 hour").start.alias("t")).agg(
        F.count("*"), F.count_if(F.col("status") == "error"), F.percentile_approx("latency_ms", 0.95, 10000), F.sum("total_tokens"), F.sum("cost_usd"),
    )
    assert got == sorted(map(tuple, want.collect())) and len(got) == 7
    assert len(batches(path)) <= 2 * 4 + 2
    # folding again, twice: what was replaced goes, the answer stays
    read = lambda: sorted(map(tuple, live.read_live_metrics(spark, path).collect()))
    before = read()
    assert live.fold(spark, path, ["t"]) > 1 and read() == before
    assert live.fold(spark, path, ["t"]) <= 1 and read() == before and len(batches(path)) == 1
    # a stream that goes on from its checkpoint adds its batches only
    source(spark, rows, 1, "2024-01-02")
    assert len(kept(spark, stream, path, str(tmp_path / "c"))) == 8
    # the last batch written again under its name
    last = [b for b in batches(path) if "fold-" not in b][-1]
    again = spark.read.option("basePath", path).parquet(last)
    before = read()
    live._save_batch(again.drop("batch"), path, last.partition("batch=")[2])
    assert read() == before


def test_a_checkpoint_made_anew_is_newer(spark, tmp_path):
    path, rows = str(tmp_path / "live"), str(tmp_path / "rows")
    stream = source(spark, rows, 3)
    first = kept(spark, stream, path, str(tmp_path / "c1"))
    source(spark, rows, 2, "2024-01-01")
    assert first != (second := kept(spark, stream, path, str(tmp_path / "c2")))
    assert sum(r[1] for r in second) == 5 * 40 and len(batches(path)) >= 8  # both streams' batches are there


def test_days_before_the_asked_time_are_not_read(spark, tmp_path):
    path = str(tmp_path / "live")
    stream = source(spark, str(tmp_path / "rows"), 1)
    source(spark, str(tmp_path / "rows"), 1, "2024-01-05")
    kept(spark, stream, path, str(tmp_path / "c"))
    some = live.read_live_metrics(spark, path, since="2024-01-05 00:00:00")
    assert some.count() == 1 and "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
