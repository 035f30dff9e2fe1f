"""From raw calls and streamed chunks to log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions import redaction, text
from callsight.functions.times import millis_between, to_millis
from callsight.operators.logs import spread
from callsight.schemas import EVENT_COLUMNS

# How a line of an event stream starts, and the line that ends it.
DATA_PREFIX = "data:"
END_MARK = "[DONE]"

# Chunks joined in one step before the parts of a reply are joined.
BLOCK = 4096


# The parts of a reply or of a chunk that are used.
_PAYLOAD = """array<struct<
    choices: array<struct<delta: struct<content: string>>>, usage: map<string, string>, model: string>>"""
_PARSER = {"allowSingleQuotes": "false"}


def payloads(json: Column) -> Column:
    """The used parts of the JSON values in a text. Parsed as a list, so that a text with
    more than one value shows, as the parser would ignore what follows the first."""
    return F.from_json(F.concat(F.lit("["), json, F.lit("]")), _PAYLOAD, _PARSER)


def only(values: Column) -> Column:
    """The value of a list of one, else null."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def usage_from_payload(parts: Column) -> Column:
    """Token counts of a reply's payload; missing, null and 0 are 0."""

    def count(name: str) -> Column:
        value = F.try_element_at(parts["usage"], F.lit(name)).try_cast("double").try_cast("bigint")
        return F.coalesce(value, F.lit(0)).alias(name)

    return F.struct(count("prompt_tokens"), count("completion_tokens"), count("total_tokens"))


def parse_sse_chunks(lines: DataFrame) -> DataFrame:
    """Chunks out of event-stream lines (request_id, seq, ts, line).

    Only `data:` lines before the end mark count; broken JSON is skipped, as are
    chunks with neither text nor usage.
    """
    data = lines.where(F.startswith("line", F.lit(DATA_PREFIX))).withColumn(
        "_payload", text.strip(F.substring("line", len(DATA_PREFIX) + 1, 2**31 - 1))
    )
    marks = spread(data.where(F.col("_payload") == END_MARK), "request_id")
    ends = marks.groupBy("request_id", "_slot").agg(F.min("seq").alias("_end"))
    before_end = data.join(ends.drop("_slot"), "request_id", "left").where(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    # Parsed as a generated column, so that the filters do not parse once more.
    parsed = before_end.select("request_id", "seq", "ts", F.explode(F.array(payloads(F.col("_payload")))).alias("_l"))
    parsed = parsed.select("request_id", "seq", "ts", only(F.col("_l")).alias("_p"))
    chunks = parsed.select(
        "request_id",
        "seq",
        "ts",
        text.blank(F.get(F.col("_p.choices"), F.lit(0))["delta"]["content"]).alias("delta"),
        F.when(F.size("_p.usage") > 0, usage_from_payload(F.col("_p"))).alias("usage"),
        F.col("_p.model").alias("model"),
    )
    return chunks.where((F.col("delta") != "") | F.col("usage").isNotNull())


def _joined(order: str, part: str) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(order, part)))
    return F.array_join(F.transform(listed, lambda x: x[part]), "")


def assemble_stream(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per request: the text in order, the last model and usage named, the time of the
    first piece of text and of the last chunk.

    A chunk that was recorded twice counts once. Long replies are joined in two steps,
    first within blocks of chunks, so no task lists all chunks of one request.
    """
    once = chunks.groupBy("request_id", "seq").agg(
        F.any_value("delta").alias("delta"),
        F.any_value("usage").alias("usage"),
        F.any_value("model").alias("model"),
        F.min("ts").alias("ts"),
    )
    filled = once.withColumn("delta", text.blank(F.col("delta")))
    said_model = F.when(text.missing_if_blank(F.col("model")).isNotNull(), F.col("seq"))
    said_usage = F.when(F.col("usage").isNotNull(), F.col("seq"))
    blocks = filled.groupBy("request_id", F.floor(F.col("seq") / block).alias("_block")).agg(
        _joined("seq", "delta").alias("_text"),
        F.max_by("model", said_model).alias("model"),
        F.max(said_model).alias("_model_at"),
        F.max_by("usage", said_usage).alias("usage"),
        F.max(said_usage).alias("_usage_at"),
        F.min(F.when(F.col("delta") != "", F.col("ts"))).alias("first_token_at"),
        F.max("ts").alias("last_chunk_at"),
    )
    return blocks.groupBy("request_id").agg(
        _joined("_block", "_text").alias("text"),
        F.max_by("model", "_model_at").alias("model"),
        F.max_by("usage", "_usage_at").alias("usage"),
        F.min("first_token_at").alias("first_token_at"),
        F.max("last_chunk_at").alias("last_chunk_at"),
    )


def finished_streams(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Streamed calls with what their chunks say, as `build_log_event` takes them.

    `calls` has a row per request with its start; `chunks` may come from `parse_sse_chunks`.
    A call without chunks ended when it started.
    """
    replies = assemble_stream(chunks).select(
        "request_id", "model", "usage", "first_token_at", "last_chunk_at", F.col("text").alias("output_text")
    )
    found = spread(calls.drop("model"), "request_id").join(replies, "request_id", "left").drop("_slot")
    return found.withColumns(
        {"streamed": F.lit(True), "ended_at": F.coalesce("last_chunk_at", "started_at")}
    ).drop("last_chunk_at")


def call_timing(calls: DataFrame) -> DataFrame:
    """Adds `latency_ms` and `ttft_ms` from started_at, first_token_at and ended_at.
    Without a first token there is no ttft."""
    return calls.withColumns(
        {
            "latency_ms": millis_between(F.col("started_at"), F.col("ended_at")),
            "ttft_ms": millis_between(F.col("started_at"), F.col("first_token_at")),
        }
    )


def estimate_prompt(messages: DataFrame, key: str) -> DataFrame:
    """Estimated prompt tokens: the sum over the messages sent."""
    return messages.groupBy(key).agg(F.sum(text.estimate_tokens(F.col("content"))).alias("prompt_tokens"))


def streaming_provider(adapter: Column, model: Column, fallback_model: str | None = None) -> Column:
    """The provider label of a streamed call.

    An adapter named `a_with_b_fallback` stands for b when the fallback model answered,
    else for a. The hosted adapter serves many providers, named by the model's prefix;
    any other adapter is its own provider.
    """
    fallback = F.regexp_extract(adapter, "_with_(.*)_fallback$", 1)
    plain = F.when(fallback == "", adapter).otherwise(F.split_part(adapter, F.lit("_with_"), F.lit(1)))
    served = F.when((fallback != "") & (model == F.lit(fallback_model)), fallback).otherwise(plain)
    return F.when(served == text.HOSTED_LABEL, text.provider_from_model(model)).otherwise(served)


def build_log_event(
    calls: DataFrame,
    redact: bool = False,
    limit: int = text.PREVIEW_CHARS,
    fallback_model: str | None = None,
) -> DataFrame:
    """The log event of each finished call.

    Needs request_id, session_id, conversation_id, streamed, adapter, requested_model,
    model and provider (as answered, may be null), status, error_type, error_message,
    started_at, first_token_at, ended_at, usage, cost_usd, input_text, output_text and
    metadata.

    A streamed call gets the provider of the model that answered (`streaming_provider`),
    also when it failed, and never a cost. Another call gets the answer's provider, or the adapter's name
    when it failed; a cancelled one leaves no event.
    """
    streamed, failed = F.col("streamed"), F.col("status") != "success"
    logged = call_timing(calls).where(streamed | (F.col("status") != "cancelled"))
    model = F.coalesce(text.missing_if_blank(F.col("model")), F.col("requested_model"))
    lost = ~streamed & failed
    previews = {
        "input_preview": text.preview(F.col("input_text"), limit),
        "output_preview": text.preview(F.when(~lost, F.col("output_text")), limit),
    }
    events = logged.withColumns(
        {
            "model": F.when(lost, F.col("requested_model")).otherwise(model),
            "provider": F.when(lost, F.col("adapter"))
            .when(streamed, streaming_provider(F.col("adapter"), model, fallback_model))
            .otherwise(F.coalesce("provider", "adapter")),
            **{
                n: F.when(lost, F.lit(0)).otherwise(F.coalesce(F.col("usage")[n], F.lit(0))).cast("bigint")
                for n in ("prompt_tokens", "completion_tokens", "total_tokens")
            },
            "cost_usd": F.when(~streamed & ~failed, F.col("cost_usd")).cast("double"),
            "error_type": F.when(F.col("status") == "error", F.col("error_type")),
            "error_message": F.when(F.col("status") == "error", F.col("error_message")),
            **previews,
            "redacted": F.lit(False),
            "created_at": to_millis(F.col("ended_at")),
            "metadata": F.coalesce("metadata", F.lit("{}")),
        }
    )
    if redact:
        events = redaction.redact_events(events, redaction.by_rules(redaction.CLIENT_RULES))
    return events.select(*EVENT_COLUMNS)
