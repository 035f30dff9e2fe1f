"""Session and scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "callsight", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Days and buckets are those of UTC; a session in another zone would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "Z", "GMT", "ETC/UTC", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}, not UTC")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder the cluster shares (`spark.checkpoint.dir`).

    Only a local session may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="callsight-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_once(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written below the scratch folder and read back, so that whatever reads them several
    times, as a range shuffle with its sample does, makes them once."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
