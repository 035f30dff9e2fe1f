"""The ingest stream: raw records -> valid, redacted log rows and dead letters."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsight.functions import redaction
from callsight.operators.events import apply_defaults, parse_events, split_valid, to_log_row
from callsight.sources.logs import write_logs
from callsight.sources.raw import write_dead_letters

log = logging.getLogger(__name__)
T = TypeVar("T")

# Tries of a store write and the first pause, doubled each time.
WRITE_TRIES = 3
FIRST_PAUSE_SECONDS = 0.5


def write_with_retry(write: Callable[[], T], tries: int = WRITE_TRIES, pause: float = FIRST_PAUSE_SECONDS) -> T:
    """Try a write again after growing pauses; returns what it returns. The last failure is raised: the batch then
    counts as not done, and the stream reads it again when it is restarted."""
    for attempt in range(1, tries + 1):
        try:
            return write()
        except Exception as exc:
            if attempt == tries:
                raise
            wait = pause * 2 ** (attempt - 1)
            log.warning("write failed (try %d of %d): %s; again in %.1f s", attempt, tries, exc, wait)
            time.sleep(wait)


def ingest_rows(
    records: DataFrame, redactor: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(log rows, dead letters) of raw records; batch or stream."""
    valid, dead = split_valid(parse_events(records))
    return to_log_row(redaction.redact_events(apply_defaults(valid), redactor)), dead


def run_ingest(
    records: DataFrame,
    logs_path: str,
    dead_path: str,
    checkpoint: str,
    redactor: Callable[[Column], Column] | None = None,
    counts_path: str | None = None,
    every: str | None = None,
    dead_sink: Callable[[DataFrame, str], None] | None = None,
) -> StreamingQuery:
    """Start the ingest stream; without `every` it takes what is there and ends.

    The stream's position moves on only after both writes of a batch are done. Until
    then the batch is read and written again under the same name, which replaces the
    first try, so a crash loses and doubles nothing. The name starts with the id that the
    checkpoint was given, so any number of streams can write into one table; a replay with
    a new checkpoint adds copies, which reads remove.

    Dead letters go to files below `dead_path`, or to `dead_sink`, which gets them with the
    batch's name (`raw.write_dead_topic` with its servers bound, say).
    """

    def bury(dead: DataFrame, name: str) -> None:
        write_dead_letters(dead, dead_path, name)

    named: list[str] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not named:  # the checkpoint's id is there once the first batch is
            named.append(stream_id(spark, checkpoint))
        name = f"{named[0]}-{batch_id:012d}"
        # Both sinks take their share of one parse.
        parsed = parse_events(batch).persist()

        def write_valid() -> dict[str, int]:
            # The write passes all rows of the batch, so they are counted on their way.
            seen = Observation()
            valid, _ = split_valid(parsed.observe(seen, *count_columns()))
            write_logs(to_log_row(redaction.redact_events(apply_defaults(valid), redactor)), logs_path, name)
            return seen.get

        try:
            counts = write_with_retry(write_valid)
            write_with_retry(lambda: (dead_sink or bury)(split_valid(parsed)[1], name))
            if counts_path:
                row = spark.createDataFrame([(counts["stored"], counts["dead"])], "stored bigint, dead bigint")
                write_with_retry(lambda: write_counts(row, batch_id, name, counts_path))
        finally:
            parsed.unpersist()

    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint was given when it was made; restarts keep it, and a
    checkpoint that was removed and made again has another one."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first().id


def write_counts(counts: DataFrame, batch_id: int, name: str, path: str) -> None:
    """Stored and dead records of one batch, one row; another try replaces it."""
    named = counts.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "batch": F.lit(name)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def count_columns() -> list[Column]:
    ok = F.size("reasons") == 0
    return [F.count_if(ok).alias("stored"), F.count_if(~ok).alias("dead")]


def ingest_counts(parsed: DataFrame) -> DataFrame:
    """Stored and dead records of a parsed batch."""
    return parsed.agg(*count_columns())
