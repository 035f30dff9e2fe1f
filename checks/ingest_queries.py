"""Validation, batches, storage and the ingest stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from callsight.functions import text
from callsight.operators import events as ops
from callsight.operators.logs import dedup_latest, dedup_stream, in_range
from callsight.plans import metrics
from callsight.session import scratch_path, stored_once
from callsight.sources import logs as table
from callsight.sources import raw
from callsight.streaming import ingest, live
from checks import inputs
from checks.inputs import DEAD_KINDS
from checks.metrics_queries import times_as_text
from checks.sql import EVENTS, iso

QUERIES, SQL = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


DEAD = ", ".join(map(str, DEAD_KINDS))
ROW = ["request_id", "session_id", "provider", "model", "status", "latency_ms", "ttft_ms", "prompt_tokens",
       "completion_tokens", "total_tokens", "cost_usd", "redacted", "created_at"]
# What the valid records must become, from the calls they were made of.
VALID = f"""
valid AS (
  SELECT event_id,
    CASE WHEN event_id % 40 = 18 THEN 'req_' || substr(sha256('raw/' || (event_id % 3) || '/' || (event_id // 3)), 1, 32)
         ELSE request_id END AS request_id,
    CASE WHEN event_id % 40 = 19 THEN '' ELSE session_id END AS session_id,
    provider, model, status, latency_ms, ttft_ms, prompt_tokens, completion_tokens, total_tokens, cost_usd,
    CAST(event_id % 40 = 12 AS INTEGER) AS redacted,
    CASE WHEN event_id % 40 = 11 THEN date_trunc('second', created_at) ELSE created_at END AS created_at,
    json_extract(props, '$.k') AS k
  FROM calls WHERE event_id % 40 NOT IN ({DEAD})
)"""
VALID_SQL = ", ".join(iso(c) + f" AS {c}" if c == "created_at" else c for c in ROW)
REASONS = """CASE event_id % 40 WHEN 1 THEN 'model' WHEN 2 THEN 'status' WHEN 3 THEN 'latency_ms' WHEN 4 THEN 'metadata'
  WHEN 5 THEN 'provider' WHEN 8 THEN 'prompt_tokens' WHEN 9 THEN 'completion_tokens' WHEN 13 THEN 'redacted' ELSE 'json' END"""


def parsed(spark, sf_dir):
    return ops.parse_events(inputs.raw_records(spark, sf_dir))


register(
    "parse_events_valid",
    lambda s, d: times_as_text(ops.to_log_row(ops.apply_defaults(ops.split_valid(parsed(s, d))[0])).select(*ROW)),
    f"WITH {EVENTS}, {VALID} SELECT {VALID_SQL} FROM valid",
)
register(
    "parse_events_dead",
    lambda s, d: ops.split_valid(parsed(s, d))[1].select("key", F.array_join("reasons", ",").alias("reasons")),
    f"SELECT 'k' || event_id AS key, {REASONS} AS reasons FROM events WHERE event_id % 40 IN ({DEAD})",
)
register(
    "to_log_row",
    lambda s, d: ops.to_log_row(ops.apply_defaults(ops.split_valid(parsed(s, d))[0])).select(
        "request_id", "conversation_id", "error_type", "error_message", "input_preview", "output_preview",
        F.get_json_object("metadata", "$.k").cast("bigint").alias("k"),
    ),
    f"""WITH {EVENTS}, {VALID} SELECT request_id, '' AS conversation_id, '' AS error_type, '' AS error_message,
      '' AS input_preview, '' AS output_preview, CAST(k AS BIGINT) AS k FROM valid""",
)
register(
    "session_key",
    lambda s, d: raw.keyed(ops.to_log_row(ops.apply_defaults(ops.split_valid(parsed(s, d))[0]))).select(
        "key", F.get_json_object("value", "$.request_id").alias("request_id")
    ),
    f"WITH {EVENTS}, {VALID} SELECT COALESCE(nullif(session_id, ''), request_id) AS key, request_id FROM valid",
)
register(
    "ingest_counts",
    lambda s, d: ingest.ingest_counts(parsed(s, d)),
    f"SELECT count(*) FILTER (event_id % 40 NOT IN ({DEAD})) AS stored, count(*) FILTER (event_id % 40 IN ({DEAD})) AS dead FROM events",
)

# A batch passes as a whole or not at all: the ones that carry a bad event, and the ones
# that are no batch, are refused.
BATCHES = f"""
batch AS (
  SELECT event_id // 50 AS batch_id, count(*) AS n,
    bool_or((event_id // 50) % 3 = 0 AND event_id % 40 IN ({DEAD})) AS bad FROM events GROUP BY 1
)"""
register(
    "reject_batches",
    lambda s, d: ops.judge_batches(inputs.envelopes(s, d)).select("batch_id", "accepted", "n_events"),
    f"""WITH {BATCHES} SELECT batch_id, NOT bad AND batch_id % 20 <> 19 AS accepted,
      CASE WHEN batch_id % 20 = 19 OR json_broken THEN 0 ELSE n END AS n_events
    FROM (SELECT *, EXISTS (SELECT 1 FROM events e WHERE e.event_id // 50 = batch_id AND batch_id % 3 = 0 AND e.event_id % 40 = 15)
      AS json_broken FROM batch)""",
)
register(
    "explode_batches",
    lambda s, d: ops.explode_batches(inputs.envelopes(s, d)).select(
        "batch_id", "position", F.get_json_object("value", "$.request_id").alias("request_id"),
        F.get_json_object("value", "$.model").alias("model"),
    ),
    f"""WITH {EVENTS}, {BATCHES}
    SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS position,
      CASE WHEN event_id % 40 <> 18 THEN request_id END AS request_id, model
    FROM batch JOIN calls ON event_id // 50 = batch_id
    WHERE NOT bad AND batch_id % 20 <> 19""",
)

# --- the stored table -------------------------------------------------------------------


def stored(spark, sf_dir):
    """The log table written in two batches, the second with the late copies."""
    path = scratch_path(spark, "logs")
    rows = inputs.over_tasks(inputs.raw_logs(spark, sf_dir))
    late = F.col("ingested_at") > F.col("created_at") + F.expr("interval 3 seconds")
    table.write_logs(rows.where(~late), path, "first", "2024-01-31 00:00:01")
    table.write_logs(rows.where(late), path, "second", "2024-01-31 00:00:06")
    return path


STORED = ["request_id", "provider", "model", "status", "latency_ms", "total_tokens", "created_at", "ingested_at"]
STORED_SQL = ", ".join(c for c in STORED[:-2]) + f", {iso('created_at')} AS created_at"


def compacted(spark, sf_dir):
    path = stored(spark, sf_dir)
    table.compact_days(spark, path, table.stored_days(spark, path))
    table.remove_replaced(spark, path, dt.timedelta(0))
    return times_as_text(table.read_logs(spark, path).select(*STORED))


register(
    "compacted_days",
    compacted,
    f"""WITH {EVENTS} SELECT {STORED_SQL},
      CASE WHEN event_id % 10 = 0 THEN '2024-01-31T00:00:06.000' ELSE '2024-01-31T00:00:01.000' END AS ingested_at FROM calls""",
)


def pruned(spark, sf_dir):
    rows = table.read_logs(spark, stored(spark, sf_dir), *inputs.RANGE)
    return times_as_text(dedup_latest(rows).select(*STORED[:-1]))


register(
    "pruned_read",
    pruned,
    f"""WITH {EVENTS} SELECT {STORED_SQL} FROM calls
    WHERE created_at BETWEEN TIMESTAMP '{inputs.RANGE[0]}' AND TIMESTAMP '{inputs.RANGE[1]}'""",
)


def latest(spark, sf_dir):
    """Some days compacted, a third of them not cleaned up, the others with their copies."""
    path = stored(spark, sf_dir)
    days = table.stored_days(spark, path)
    table.compact_days(spark, path, days[: len(days) // 3])
    table.remove_replaced(spark, path, dt.timedelta(0))
    table.compact_days(spark, path, days[len(days) // 3 : len(days) // 2])
    return times_as_text(table.read_latest(spark, path).select(*STORED[:-1]))


def looked_up(spark, sf_dir):
    """About 150 calls by their ids, half of the days compacted."""
    path = stored(spark, sf_dir)
    days = table.stored_days(spark, path)
    table.compact_days(spark, path, days[: len(days) // 2])
    ids = inputs.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    wanted = [f"req_{i:010d}" for i in range(0, ids + 1, max(1, ids // 150))]
    return times_as_text(table.read_requests(spark, path, wanted).select(*STORED[:-1]))


register(
    "lookup_requests",
    looked_up,
    f"""WITH {EVENTS} SELECT {STORED_SQL} FROM calls
    WHERE event_id % greatest(1, (SELECT max(event_id) FROM events) // 150) = 0""",
)
register("latest_read", latest, f"WITH {EVENTS} SELECT {STORED_SQL} FROM calls")


def expired(spark, sf_dir):
    path = stored(spark, sf_dir)
    table.drop_expired(spark, path, dt.datetime(2024, 4, 15, 10, 20, 30))
    return table.read_logs(spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


register(
    "expired_days",
    expired,
    f"""WITH {EVENTS} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM raw_logs
    WHERE date_trunc('day', created_at) + INTERVAL 1 DAY > TIMESTAMP '2024-04-15 10:20:30' - INTERVAL 90 DAY GROUP BY 1""",
)

# --- streams ----------------------------------------------------------------------------

FILES = 4
FILES_PER_PART = 2
FILE_ROWS = 250_000  # about as many to a file: larger batches are more files


def files_of(rows, least=1):
    """Files that so many rows take."""
    return max(least, -(-rows // FILE_ROWS))


def record_files(spark, sf_dir):
    """The raw records as FILES times several files, so that a stream takes several batches; and how many times."""
    path, records = scratch_path(spark, "raw"), inputs.raw_records(spark, sf_dir)
    each = files_of(-(-inputs.table(spark, sf_dir, "events").count() // FILES))
    records.repartition(FILES * each, "offset").write.json(path)
    return path, each


def ingested(spark, sf_dir):
    logs, dead, counts = (scratch_path(spark, n) for n in ("logs", "dead", "counts"))
    records = raw.read_raw_stream(spark, *record_files(spark, sf_dir))
    ingest.run_ingest(records, logs, dead, scratch_path(spark, "checkpoint"), counts_path=counts).awaitTermination()
    return logs, dead, counts


def two_topics(spark, sf_dir):
    """Two streams with checkpoints of their own into the same tables."""
    logs, dead = scratch_path(spark, "logs"), scratch_path(spark, "dead")
    for part in ("partition = 0", "partition > 0"):
        path = scratch_path(spark, "raw")
        inputs.raw_records(spark, sf_dir).where(part).repartition(FILES).write.json(path)
        records = raw.read_raw_stream(spark, path, 2)
        ingest.run_ingest(records, logs, dead, scratch_path(spark, "checkpoint")).awaitTermination()
    return logs, dead


def replayed(spark, sf_dir):
    """The same records twice, each time from the start, into the same table."""
    path, each = record_files(spark, sf_dir)
    logs, dead = scratch_path(spark, "logs"), scratch_path(spark, "dead")
    for _ in range(2):
        records = raw.read_raw_stream(spark, path, 2 * each)
        ingest.run_ingest(records, logs, dead, scratch_path(spark, "checkpoint")).awaitTermination()
    return logs


def intact(letters, spark, sf_dir):
    """Dead letters, and whether each still has the bytes of its record."""
    sent = inputs.raw_records(spark, sf_dir).select("key", F.col("value").alias("sent"))
    same = F.coalesce(F.col("value") == F.col("sent"), F.lit(False))
    return letters.join(sent, "key").select("key", F.array_join("reasons", ",").alias("reasons"), same.alias("intact"))


register(
    "stream_ingest_logs",
    lambda s, d: times_as_text(table.read_logs(s, ingested(s, d)[0]).select(*ROW)),
    SQL["parse_events_valid"],
)
DEAD_INTACT = f"SELECT *, true AS intact FROM ({SQL['parse_events_dead']})"
register("stream_dead_letters", lambda s, d: intact(raw.read_dead_letters(s, ingested(s, d)[1]), s, d), DEAD_INTACT)
register(
    "stream_two_topics",
    lambda s, d: times_as_text(table.read_logs(s, two_topics(s, d)[0]).select(*ROW)),
    SQL["parse_events_valid"],
)
register("stream_two_topics_dead", lambda s, d: intact(raw.read_dead_letters(s, two_topics(s, d)[1]), s, d), DEAD_INTACT)
register(
    "stream_replay_same_table",
    lambda s, d: times_as_text(table.read_latest(s, replayed(s, d)).select(*ROW)),
    SQL["parse_events_valid"],
)


def kept_events(spark, sf_dir):
    """The valid events, parsed once for all writes of them."""
    events = ops.to_log_row(ops.apply_defaults(ops.split_valid(parsed(spark, sf_dir))[0]))
    return stored_once(events.withColumn("metadata", F.from_json("metadata", "map<string,string>")), "events")


def round_trip(spark, sf_dir):
    """Events written as raw records and ingested again; the second write replaces the first."""
    path = scratch_path(spark, "raw")
    events = kept_events(spark, sf_dir)
    for _ in range(2):
        raw.write_raw(events, path, "1")
    return times_as_text(ingest.ingest_rows(raw.read_raw(spark, path))[0].select(*ROW))


def offsets(spark, sf_dir):
    """Two batches of records, the first one written a second time behind the other."""
    path = scratch_path(spark, "raw")
    events = kept_events(spark, sf_dir)
    early = F.col("created_at") < inputs.RANGE[0]
    for part, name in ((events.where(early), "1"), (events.where(~early), "2"), (events.where(early), "1")):
        raw.write_raw(part, path, name)
    return raw.read_raw(spark, path).select(
        F.get_json_object(F.col("value").cast("string"), "$.request_id").alias("request_id"), "key", "partition", "offset"
    )


register(
    "raw_offsets",
    offsets,
    f"""WITH {EVENTS}, {VALID}, r AS (SELECT request_id, COALESCE(nullif(session_id, ''), request_id) AS key, created_at FROM valid),
    p AS (SELECT *, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 3 AS INTEGER) AS "partition" FROM r)
    SELECT request_id, key, "partition", row_number() OVER (PARTITION BY "partition" ORDER BY created_at, key, request_id) - 1 AS "offset" FROM p""",
)
register("raw_round_trip", round_trip, SQL["parse_events_valid"])
register(
    "stream_ingest_counts",
    lambda s, d: s.read.schema("batch_id bigint, stored bigint, dead bigint").parquet(ingested(s, d)[2]).agg(
        F.sum("stored").alias("stored"), F.sum("dead").alias("dead")
    ),
    SQL["ingest_counts"],
)


def stream_by_time(spark, rows, time):
    """The rows as a stream of parts in the order of time, one part per batch."""
    source = scratch_path(spark, "source")
    rows.write.parquet(source)
    rows = spark.read.schema(rows.schema).parquet(source)
    cuts = rows.agg(F.percentile_approx(F.unix_micros(time), [i / FILES for i in range(1, FILES)]).alias("c"))
    part = F.size(F.filter(F.lit(cuts.first()["c"]), lambda c: c < F.unix_micros(time)))
    return stream_of_parts(spark, [rows.where(part == i) for i in range(FILES)])


def stream_of_parts(spark, parts):
    """A batch per part. A file stream takes the oldest files first, so the parts are
    written one after the other, in equally many files: so many that the largest part's are
    not too large, if the smallest has rows for all of them."""
    path, rows = scratch_path(spark, "rows"), parts[0]
    sizes = [part.count() for part in parts]
    files = max(FILES_PER_PART, min(files_of(max(sizes)), min(sizes) // 1000))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def log_stream(spark, sf_dir):
    return stream_by_time(spark, inputs.raw_logs(spark, sf_dir), "created_at")


def run_to_table(df, spark, mode="append"):
    """Run a stream until nothing is left and return what it wrote."""
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


register(
    "stream_dedup",
    lambda s, d: times_as_text(
        run_to_table(dedup_stream(log_stream(s, d), "1 hour"), s).select("request_id", "provider", "latency_ms", "created_at")
    ),
    f"WITH {EVENTS} SELECT request_id, provider, latency_ms, {iso('created_at')} AS created_at FROM calls",
)


def live_table(spark, sf_dir):
    """All buckets, the open ones as far as they go."""
    path = scratch_path(spark, "live")
    found = live.live_metrics(log_stream(spark, sf_dir), 21600, "1 hour", ("provider",))
    live.keep_live_metrics(found, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return live.read_live_metrics(spark, path, ("provider",))


register(
    "stream_live_metrics",
    lambda s, d: times_as_text(
        live_table(s, d).select(
            "t", "provider", "requests", "errors", "tokens", F.bround("cost_usd", 6).alias("cost_usd"), "p95_ms"
        )
    ),
    f"""WITH {EVENTS}, b AS (SELECT time_bucket(INTERVAL 21600 SECOND, created_at, TIMESTAMP '1970-01-01') AS bucket, * FROM raw_logs)
    SELECT {iso('bucket')} AS t, provider, count(*) AS requests, count(*) FILTER (status = 'error') AS errors,
      CAST(sum(total_tokens) AS BIGINT) AS tokens, round_even(sum(cost_usd), 6) AS cost_usd,
      quantile_disc(latency_ms, 0.95) AS p95_ms
    FROM b GROUP BY bucket, provider""",
)


def late(spark, sf_dir):
    """The newest rows come first, in two batches, so that the others are late."""
    counts, table_, rows = scratch_path(spark, "late"), scratch_path(spark, "live"), inputs.raw_logs(spark, sf_dir)
    kinds = ("created_at >= '2024-01-25'", "created_at >= '2024-01-23' and created_at < '2024-01-25'", "created_at < '2024-01-23'")
    stream = stream_of_parts(spark, [rows.where(kind) for kind in kinds])
    live.keep_input_counts(stream, counts, scratch_path(spark, "checkpoint")).awaitTermination()
    metrics_ = live.live_metrics(stream, 21600, "1 hour")
    live.keep_live_metrics(metrics_, table_, scratch_path(spark, "checkpoint")).awaitTermination()
    return live.late_rows(spark, counts, table_)


# A batch leaves out the rows behind the newest row of the batches before the last one.
register(
    "stream_late_rows",
    late,
    f"WITH {EVENTS} SELECT count(*) AS late FROM raw_logs WHERE created_at < TIMESTAMP '2024-01-23 00:00:00'",
)


def folded_live_table(spark, sf_dir):
    """Fifty batches, folded every eighth."""
    path, rows = scratch_path(spark, "live"), inputs.raw_logs(spark, sf_dir)
    source = scratch_path(spark, "source")
    rows.repartitionByRange(BATCHES_FOLDED, "created_at", "request_id", "ingested_at").sortWithinPartitions("created_at").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = live.live_metrics(stream, 86400, "60 days")
    live.keep_live_metrics(found, path, scratch_path(spark, "checkpoint"), fold_every=8).awaitTermination()
    return live.read_live_metrics(spark, path)


BATCHES_FOLDED = 50
register(
    "stream_live_metrics_folded",
    lambda s, d: times_as_text(
        folded_live_table(s, d).select("t", "requests", "errors", "tokens", F.bround("cost_usd", 6).alias("cost_usd"), "p95_ms")
    ),
    f"""WITH {EVENTS}, b AS (SELECT time_bucket(INTERVAL 86400 SECOND, created_at, TIMESTAMP '1970-01-01') AS bucket, * FROM raw_logs)
    SELECT {iso('bucket')} AS t, count(*) AS requests, count(*) FILTER (status = 'error') AS errors,
      CAST(sum(total_tokens) AS BIGINT) AS tokens, round_even(sum(cost_usd), 6) AS cost_usd,
      quantile_disc(latency_ms, 0.95) AS p95_ms
    FROM b GROUP BY bucket""",
)
