"""Live metrics, and the replies that a live assembly (see `replies`) did not get to close."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsight.functions.times import as_time
from callsight.operators.calls import assemble_stream
from callsight.operators.logs import Time
from callsight.plans.metrics import cost, errors, requests, tokens
from callsight.sources.logs import folders, remove
from callsight.streaming.ingest import stream_id


def live_metrics(
    logs: DataFrame, bucket_seconds: int, delay: str, by: tuple[str, ...] = (), accuracy: int = 10000
) -> DataFrame:
    """Requests, errors, p95 latency, tokens and cost per bucket of a stream.

    The percentile is a summary of fixed size, so the state does not grow with the
    traffic. `delay` is how late a row may come; later ones are left out here (see
    `late_rows`) but still reach the log table. Columns in `by` split the buckets.
    """
    return (
        logs.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", f"{bucket_seconds} seconds"), *by)
        .agg(
            requests().alias("requests"),
            errors().alias("errors"),
            F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_ms"),
            tokens().alias("tokens"),
            cost().alias("cost_usd"),
        )
        .select(F.col("window.start").alias("t"), *by, "requests", "errors", "p95_ms", "tokens", "cost_usd")
    )


# --- a kept table of changing rows -------------------------------------------------------------
#
# Every batch of a query adds the rows that it has changed, with its `version`, and readers take the
# newest version of each key. From time to time the versions of a day are folded into one file; what a
# fold has replaced goes with the next fold, so that a reader that has listed it can end.

FOLD_EVERY = 20
_FOLD = "fold-"
_STREAMS = "_streams"  # the order in which streams began to write; table scans pass it by
_REPLACED = "_replaced"
MAX_BATCHES = 1 << 40


def _generation(spark: SparkSession, path: str, stream: str) -> int:
    """The number of a stream among those that have written to the table, from 0. A checkpoint that is
    made anew has a new id, and its batches are newer than all before."""
    known = {n: i for i, n in enumerate(sorted(folders(spark, f"{path}/{_STREAMS}")))}
    for name, number in known.items():
        if name.partition("-")[2] == stream:
            return number
    spark.range(1).coalesce(1).write.mode("overwrite").json(f"{path}/{_STREAMS}/{len(known):06d}-{stream}")
    return len(known)


def _save_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Replaces what an earlier try of the batch has left."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day", "batch").parquet(path)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "day", "batch")]
    newest = rows.groupBy("day", *keys).agg(F.max_by(F.struct(*values), "version").alias("_now"))
    return newest.select("day", *keys, "_now.*")


def fold(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Folds the days that have more than one batch and removes what the fold before has replaced;
    returns how many folders it has read. Rows of a key keep the newest version, so a fold that is
    repeated, or that meets a batch again, changes nothing."""
    for record in folders(spark, f"{path}/{_REPLACED}"):
        rows = spark.read.schema("folder string").json(f"{path}/{_REPLACED}/{record}")
        for row in rows.collect():
            remove(spark, f"{path}/{row.folder}")
        remove(spark, f"{path}/{_REPLACED}/{record}")
    old = []
    for day in (n for n in folders(spark, path) if n.startswith("day=")):
        batches = folders(spark, f"{path}/{day}")
        old += [f"{day}/{b}" for b in batches] if len(batches) > 1 else []
    if not old:
        return 0
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{folder}" for folder in old])
    _save_batch(_newest(rows, keys).repartition("day"), path, f"{_FOLD}{uuid.uuid4().hex}")
    replaced = spark.createDataFrame([(folder,) for folder in old], "folder string")
    replaced.coalesce(1).write.json(f"{path}/{_REPLACED}/{uuid.uuid4().hex}")
    return len(old)


def _keep(rows: DataFrame, path: str, checkpoint: str, keys: list[str], every, fold_every, mode=None) -> StreamingQuery:
    """rows: a stream with a `day`, or what a batch makes of one. A batch is a folder per day that it has
    changed, named by its stream and number; folding happens ahead of every `fold_every`-th batch."""
    generation: list[int] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = stream_id(spark, checkpoint)
        if not generation:
            generation.append(_generation(spark, path, stream))
        if batch_id and batch_id % fold_every == 0:
            fold(spark, path, keys)
        if mode is not None:
            batch = mode(batch)
        version = F.lit(generation[0] * MAX_BATCHES + batch_id).cast("bigint")
        _save_batch(batch.withColumn("version", version), path, f"{stream}-{batch_id:012d}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    writer = writer if mode else writer.outputMode("update")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


VALUES = ["requests", "errors", "p95_ms", "tokens", "cost_usd"]


def keep_live_metrics(
    metrics: DataFrame, path: str, checkpoint: str, every: str | None = None, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Keeps the stream of `live_metrics` as a table that also shows the open buckets: every
    batch adds the buckets that it has changed, `read_live_metrics` takes the newest state."""
    keys = [c for c in metrics.columns if c not in VALUES]
    return _keep(metrics.withColumn("day", F.to_date("t")), path, checkpoint, keys, every, fold_every)


def read_live_metrics(
    spark: SparkSession, path: str, by: tuple[str, ...] = (), since: Time | None = None
) -> DataFrame:
    """The newest state of every bucket, of the days from `since` on: a row per bucket and what
    the batches after the last fold have added."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.where((F.col("day") >= F.to_date(as_time(since))) & (F.col("t") >= as_time(since)))
    return _newest(rows, ["t", *by]).select("t", *by, *VALUES)


def keep_input_counts(
    logs: DataFrame, path: str, checkpoint: str, every: str | None = None, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Counts a stream's rows by batch, a row each, for `late_rows`."""
    name = F.lit("1970-01-01").cast("date").alias("day")
    count = lambda rows: rows.agg(F.count(F.lit(1)).alias("n")).select(name, "n")
    return _keep(logs, path, checkpoint, ["version"], every, fold_every, count)


def late_rows(spark: SparkSession, counts_path: str, metrics_path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows the kept live metrics have left out: those that came in, less those that
    some bucket counts. Exact when both queries have got equally far."""
    counts = spark.read.schema("n bigint, version bigint").parquet(counts_path).dropDuplicates(["version"])
    came = counts.agg(F.sum("n").alias("came"))
    counted = read_live_metrics(spark, metrics_path, by).agg(F.sum("requests").alias("counted"))
    both = came.withColumn("sign", F.lit(1)).union(counted.withColumn("sign", F.lit(-1)))
    return both.agg(F.coalesce(F.sum(F.col("came") * F.col("sign")), F.lit(0)).alias("late"))


def whole_replies(closed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The replies that a live assembly has written, and those still open, from the chunks."""
    still_open = chunks.join(closed.select("request_id").distinct(), "request_id", "left_anti")
    return closed.unionByName(assemble_stream(still_open))
