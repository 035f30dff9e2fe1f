"""Conversations and messages, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsight.schemas import CONVERSATION_SCHEMA, MESSAGE_SCHEMA


def read_chat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) from the two folders of a snapshot."""
    conversations = spark.read.schema(CONVERSATION_SCHEMA).parquet(f"{path}/conversations")
    return conversations, spark.read.schema(MESSAGE_SCHEMA).parquet(f"{path}/messages")


def read_chat_jdbc(
    spark: SparkSession, url: str, since: str, until: str, parallel: int = 32, **options: str
) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) from a database, each read in `parallel` ranges of
    created_at. Rows outside since ... until are read too, by the first and last range."""

    def table(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
        ranges = {"partitionColumn": "created_at", "lowerBound": since, "upperBound": until}
        return reader.options(**ranges, numPartitions=parallel).load()

    return table("conversations"), table("messages")


def write_chat(conversations: DataFrame, messages: DataFrame, path: str) -> None:
    """A new snapshot in a new folder; snapshots are never changed in place."""
    conversations.select(*CONVERSATION_SCHEMA.names).write.parquet(f"{path}/conversations")
    messages.select(*MESSAGE_SCHEMA.names).write.parquet(f"{path}/messages")
