"""The raw topic and its stand-in on files, and dead letters.

A record has the columns of `RAW_SCHEMA`; its value is bytes, in files as base64. With the Kafka package on the class path the
topic itself is read and written; otherwise, JSON-lines files of the same records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.functions.text import session_key
from callsight.schemas import RAW_SCHEMA
from callsight.session import stored_once
from callsight.sources.logs import folders

# Topics, partitions of the raw topic.
RAW_TOPIC = "inference.logs.raw"
DEAD_TOPIC = "inference.logs.dlq"
RAW_PARTITIONS = 3


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).json(path)


def read_raw_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Records from files, oldest files first; all that there are, or so many at a time."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def read_raw_topic(
    spark: SparkSession, servers: str, topic: str = RAW_TOPIC, max_per_trigger: int | None = None
) -> DataFrame:
    """Records from the topic's start, all that there are or at most `max_per_trigger` at a
    time. The place read up to is kept in the query's checkpoint, not in a consumer group."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    records = (reader.option("maxOffsetsPerTrigger", max_per_trigger) if max_per_trigger else reader).load()
    return records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA])


def keyed(events: DataFrame) -> DataFrame:
    """Events as (key, value, created_at): the JSON text, keyed by session, else by request, and its time."""
    key = session_key(F.col("session_id"), F.col("request_id"))
    time = F.col("created_at") if "created_at" in events.columns else F.lit(None).cast("timestamp")
    return events.select(
        key.alias("key"), F.to_json(F.struct(*events.columns)).alias("value"), time.alias("created_at")
    )


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a key, by its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(partitions)).cast("int")


OFFSETS = "_offsets"  # per batch: partition, first offset, number of records; reads of records pass it by
ORDER = ["partition", "created_at", "key", "value"]


def numbered(records: DataFrame, order: Sequence[str], by: str, name: str = "numbered") -> DataFrame:
    """`records` with `number`, from 0 without gaps within each value of `by`, in the given order.

    The order begins with `by`. Rows are dealt to tasks by ranges of the whole order, so one value may
    lie in many tasks. Each task numbers its own rows, and the counts per value and task, a few rows
    each, say how many come before them. The rows are made once, before the sample of the ranges.
    """
    own = F.monotonically_increasing_id()  # task number and place in the task
    ranged = stored_once(records, f"{name}-unsorted").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_task": F.shiftright(own, 33), "_place": own})
    rows = stored_once(placed, name)  # the ranges come from a sample: taken once
    counts = rows.groupBy(by, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place") - F.col("_first")
    return rows.join(starts, [by, "_task"]).withColumn("number", number).drop("_task", "_place", "_first", "_before")


def _first_offsets(spark: SparkSession, path: str, batch: str) -> dict[int, int]:
    """Where a batch's offsets begin in each partition: where they did when it was written before, else
    behind all that is there."""
    names = folders(spark, f"{path}/{OFFSETS}")
    if not names:
        return {}
    known = spark.read.schema("partition int, first bigint, n bigint, batch string").parquet(f"{path}/{OFFSETS}")
    if f"batch={batch}" in names:
        return {r.partition: r.first for r in known.where(F.col("batch") == batch).collect()}
    ends = known.groupBy("partition").agg(F.max(F.col("first") + F.col("n")).alias("end"))
    return {r.partition: r.end for r in ends.collect()}


def write_raw(
    events: DataFrame, path: str, batch_id: str, topic: str = RAW_TOPIC, partitions: int = RAW_PARTITIONS
) -> None:
    """Store events (with `created_at`) as record files, as the topic would hold them.

    The key decides the partition; in a partition, records have offsets without gaps in the order
    of time, so those of a session keep their order. Writing a batch again replaces it and gives the
    same offsets; a later batch goes on behind those that are there.
    """
    batch, spark = str(batch_id), events.sparkSession
    records = keyed(events).withColumn("partition", partition_of(F.col("key"), partitions))
    placed = numbered(records, ORDER, "partition", "records")
    first = _first_offsets(spark, path, batch)
    starts = [F.lit(first.get(p, 0)).cast("bigint") for p in range(partitions)]
    stored = placed.select(
        "key",
        F.col("value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        "partition",
        (F.element_at(F.array(*starts), F.col("partition") + 1) + F.col("number")).alias("offset"),
        F.current_timestamp().alias("timestamp"),
        F.lit(batch).alias("batch"),
    )
    counts = placed.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    told = counts.select(
        "partition", F.element_at(F.array(*starts), F.col("partition") + 1).alias("first"), "n", F.lit(batch).alias("batch")
    )
    # offsets first: a try that ends between the two writes is replaced by one with the same offsets
    for rows, where in ((told.coalesce(1), f"{path}/{OFFSETS}"), (stored, path)):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
        writer.parquet(where) if where != path else writer.json(where)


def write_raw_topic(events: DataFrame, servers: str, topic: str = RAW_TOPIC) -> None:
    """Produce events; the broker's clients hash the key to a partition."""
    keyed(events).drop("created_at").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option(
        "kafka.acks", "all"
    ).option("kafka.enable.idempotence", "true").save()


def write_dead_letters(dead: DataFrame, path: str, batch_id: str) -> None:
    """Records as they came, with the reasons. Writing a batch again replaces it."""
    dead.withColumn("batch", F.lit(str(batch_id))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def write_dead_topic(dead: DataFrame, servers: str, topic: str = DEAD_TOPIC) -> None:
    dead.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).option("kafka.acks", "all").save()


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMA)
    return spark.read.schema(f"{schema}, reasons array<string>, batch string").parquet(path)
