"""The log table: Parquet below `day=.../batch=...`.

Every write has a batch name and replaces what an earlier try of the same batch left,
so a replayed batch doubles nothing. Rows lie sorted by the dedup key, which starts with
the time: day directories and row-group statistics both cut time ranges.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsight.functions.times import RETENTION_DAYS, as_time, to_millis
from callsight.operators.logs import Time, dedup_latest, in_range
from callsight.schemas import EVENT_COLUMNS, LOG_KEYS, LOG_SCHEMA
from callsight.session import require_utc

TABLE_SCHEMA = T.StructType(
    [*LOG_SCHEMA.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())]
)
FAR_PAST, FAR_FUTURE = "0001-01-01", "9999-12-31"
COMPACTED = "compact-"
RECORDS = "_compactions"  # what compactions have replaced; table scans pass it by
FILE_BYTES = 32 << 20  # in memory, to be sorted, the rows of a file take some fifteen times as much
GRACE = dt.timedelta(hours=24)
BLOOM = {"parquet.bloom.filter.enabled#request_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
MAX_LOOKUP, LISTED = 200, 10  # LISTED: what Spark pushes as conditions, spark.sql.parquet.pushdown.inFilterThreshold
_PLACE = re.compile(r"/day=(\d{4}-\d{2}-\d{2})/batch=([^/]+)/")


def write_logs(rows: DataFrame, path: str, batch_id: str, ingested_at: Time | None = None) -> None:
    """Store log rows (the 19 event columns). No shuffle: each task writes its own rows,
    and `compact_days` makes large files of a day later."""
    require_utc(rows.sparkSession)
    arrived = F.current_timestamp() if ingested_at is None else as_time(ingested_at)
    stamped = rows.select(*EVENT_COLUMNS).withColumn("ingested_at", to_millis(arrived))
    _save(stamped.withColumn("day", F.to_date("created_at")), path, str(batch_id))


def _save(rows: DataFrame, path: str, batch: str, options: dict[str, str] | None = None) -> None:
    (
        rows.withColumn("batch", F.lit(batch))
        .sortWithinPartitions("day", *LOG_KEYS)
        .write.mode("overwrite")
        .options(**(options or {}))
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch")
        .parquet(path)
    )


def read_logs(spark: SparkSession, path: str, since: Time | None = None, until: Time | None = None) -> DataFrame:
    """The table's rows of a time range, copies included; only its days are listed and read."""
    rows = spark.read.schema(TABLE_SCHEMA).parquet(path)
    return in_range(rows, since or FAR_PAST, until or FAR_FUTURE) if since or until else rows


def _days_table(spark: SparkSession, path: str, since: Time | None, until: Time | None) -> DataFrame:
    """The table, or the folders of the asked days alone."""
    reader = spark.read.schema(TABLE_SCHEMA)
    if not since and not until:
        return reader.parquet(path)
    first, last = str(since or FAR_PAST)[:10], str(until or FAR_FUTURE)[:10]
    days = [f"{path}/day={day}" for day in map(str, stored_days(spark, path)) if first <= day <= last]
    return reader.option("basePath", path).parquet(*days) if days else spark.createDataFrame([], TABLE_SCHEMA)


def read_requests(
    spark: SparkSession, path: str, request_ids: Sequence[str], since: Time | None = None, until: Time | None = None
) -> DataFrame:
    """The rows of some calls, at most MAX_LOOKUP, one row per call.

    The ids are pushed to the files as conditions of at most LISTED ids each, as longer lists are
    pushed as a range only. Compacted days have Bloom filters of the ids, so row groups that hold none
    of them are passed over.
    """
    wanted = sorted(set(request_ids))
    if len(wanted) > MAX_LOOKUP:
        raise ValueError(f"{len(wanted)} ids; join with the log table instead")
    rows = _days_table(spark, path, since, until)
    if since or until:
        rows = in_range(rows, since or FAR_PAST, until or FAR_FUTURE)
    held = F.lit(False)
    for at in range(0, len(wanted), LISTED):
        held = held | F.col("request_id").isin(wanted[at : at + LISTED])
    return dedup_latest(rows.where(held).drop("batch"))


def read_latest(spark: SparkSession, path: str, since: Time | None = None, until: Time | None = None) -> DataFrame:
    """One row per call of a time range.

    A day that is one compacted batch holds no copies and is read as it lies; only days
    with newer batches pay for the removal of copies, as a rule the current one. Which days
    these are is taken from the files that the scan itself has listed, so a batch that
    arrives meanwhile is either seen by both or by none. Files of other days are not listed.
    """
    table = _days_table(spark, path, since, until)
    held: dict[str, set[str]] = {}
    for file in table.inputFiles():
        if place := _PLACE.search(file):
            held.setdefault(place[1], set()).add(place[2])
    settled = [day for day, batches in held.items() if len(batches) == 1 and min(batches).startswith(COMPACTED)]
    if since or until:
        table = in_range(table, since or FAR_PAST, until or FAR_FUTURE)
    rows = table.drop("batch")
    is_settled = F.coalesce(F.col("day").cast("string").isin(settled), F.lit(False))
    return rows.where(is_settled).unionByName(dedup_latest(rows.where(~is_settled)))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of the table's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()] if fs.exists(hadoop) else []


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored_days(spark: SparkSession, path: str) -> list[dt.date]:
    names = [n[len("day=") :] for n in folders(spark, path) if n.startswith("day=")]
    return sorted(dt.date.fromisoformat(n) for n in names if n != "__HIVE_DEFAULT_PARTITION__")


def _bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def compact_days(spark: SparkSession, path: str, days: Iterable[dt.date], file_bytes: int = FILE_BYTES) -> None:
    """Collapse copies within whole days and write each day anew as one batch.

    The old batches stay until `remove_replaced`: a query that has planned to read them can
    end, and reads remove the copies meanwhile. A crash leaves copies and never a gap. A
    batch that arrives meanwhile stays. Copies agree on created_at, so they never lie in
    two days. The rows are cut into ranges of time of about `file_bytes`: a large day becomes
    several files that do not overlap, and an hour's query opens few of them.
    """
    days = list(days)
    old = [
        f"{path}/day={day}/{batch}"
        for day in days
        for batch in folders(spark, f"{path}/day={day}")
        if batch.startswith("batch=")
    ]
    if not old:
        return
    rows = spark.read.schema(TABLE_SCHEMA).option("basePath", path).parquet(*old)
    ranges = max(1, -(-sum(_bytes(spark, folder) for folder in old) // file_bytes))
    name = f"{COMPACTED}{uuid.uuid4().hex}"
    _save(dedup_latest(rows).drop("batch").repartitionByRange(ranges, "day", *LOG_KEYS), path, name, BLOOM)
    replaced = spark.createDataFrame([(folder[len(path) + 1 :],) for folder in old], "folder string")
    replaced.withColumn("at", F.current_timestamp()).coalesce(1).write.json(f"{path}/{RECORDS}/{name}")


def remove_replaced(spark: SparkSession, path: str, grace: dt.timedelta = GRACE) -> int:
    """Remove the batches that compactions older than `grace` have replaced; returns how many.
    `grace` must be longer than any query over the table takes."""
    records = [f"{path}/{RECORDS}/{name}" for name in folders(spark, f"{path}/{RECORDS}")]
    gone = 0
    for record in records:
        rows = spark.read.schema("folder string, at timestamp").json(record)
        seconds = int(grace.total_seconds())
        old = [r.folder for r in rows.where(F.col("at") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds))).collect()]
        for folder in old:
            remove(spark, f"{path}/{folder}")
        if old:
            remove(spark, record)
        gone += len(old)
    return gone


def drop_expired(spark: SparkSession, path: str, as_of: dt.datetime, keep_days: int = RETENTION_DAYS) -> list[dt.date]:
    """Remove the days that lie beyond the retention as a whole; returns them. Rows of the
    day on the border are hidden by `retain`."""
    oldest = as_of - dt.timedelta(days=keep_days)
    gone = [
        d for d in stored_days(spark, path) if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1) <= oldest
    ]
    for day in gone:
        remove(spark, f"{path}/day={day}")
    return gone
