"""Tables of the engine: columns, types, enums and keys."""

from __future__ import annotations

from pyspark.sql import types as T

# The states a call, a conversation, a message and a role can have.
CALL_STATUSES = ("success", "error", "cancelled")
CONVERSATION_STATUSES = ("active", "cancelled", "archived")
MESSAGE_STATUSES = ("complete", "error", "cancelled")
ROLES = ("system", "user", "assistant")

# The largest token count the log table can hold (unsigned 32 bit).
MAX_TOKENS = 4294967295

# One row per model call. `ingested_at` is set by the writer, not by the event.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_type", T.StringType(), False),
        T.StructField("error_message", T.StringType(), False),
        T.StructField("latency_ms", T.DoubleType(), False),
        T.StructField("ttft_ms", T.DoubleType(), True),
        T.StructField("prompt_tokens", T.LongType(), False),
        T.StructField("completion_tokens", T.LongType(), False),
        T.StructField("total_tokens", T.LongType(), False),
        T.StructField("cost_usd", T.DoubleType(), True),
        T.StructField("input_preview", T.StringType(), False),
        T.StructField("output_preview", T.StringType(), False),
        T.StructField("redacted", T.IntegerType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("ingested_at", T.TimestampType(), False),
    ]
)
EVENT_COLUMNS = [f.name for f in LOG_SCHEMA if f.name != "ingested_at"]

# Rows that agree on these columns are copies of one call.
LOG_KEYS = ["created_at", "provider", "model", "request_id"]

# A record of the raw topic, or of a file that stands in for it.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

CONVERSATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

USAGE_TYPE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)

# One streamed piece of a reply.
CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("delta", T.StringType()),
        T.StructField("usage", USAGE_TYPE),
        T.StructField("model", T.StringType()),
    ]
)
