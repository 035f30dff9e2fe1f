"""Raw calls and chunks to log events."""

from __future__ import annotations

from pyspark.sql import functions as F

from callsight.functions import text
from callsight.functions.redaction import CLIENT_RULES
from callsight.operators import calls as ops
from callsight.streaming import live, replies
from checks import inputs
from checks.ingest_queries import run_to_table, stream_by_time
from checks.metrics_queries import times_as_text
from checks.sql import EVENTS, MESSAGES, iso, model_of
from checks.text_queries import scrubbed

QUERIES, SQL = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def flat(assembled):
    return times_as_text(
        assembled.select("request_id", "text", "model", "usage.*", "first_token_at", "last_chunk_at")
    )


# The first piece with text in it marks the first token.
_LEAD = "list_position(list_transform(string_split(content, ' '), lambda w, i: CASE WHEN w <> '' OR i > 1 THEN 1 ELSE 0 END), 1)"
ASSEMBLED = f"""SELECT id AS request_id, content AS text, 'north/aurora-small' AS model, 7 AS prompt_tokens,
  len(string_split(content, ' ')) AS completion_tokens, len(string_split(content, ' ')) + 7 AS total_tokens,
  {iso(f'created_at + to_milliseconds(20 * {_LEAD})')} AS first_token_at,
  {iso("created_at + to_milliseconds(20 * (len(string_split(content, ' ')) + 1))")} AS last_chunk_at
  FROM messages WHERE role = 'assistant'"""

register(
    "assemble_stream",
    lambda s, d: flat(ops.assemble_stream(inputs.chunks(s, d))),
    f"WITH {MESSAGES} {ASSEMBLED}",
)
register(
    "assemble_stream_in_small_blocks",
    lambda s, d: flat(ops.assemble_stream(inputs.chunks(s, d).unionByName(inputs.chunks(s, d)), block=16)),
    f"WITH {MESSAGES} {ASSEMBLED}",
)


def live_assembly(spark, sf_dir):
    """The replies that the stream closes, and the last ones."""
    chunks = inputs.chunks(spark, sf_dir)
    stream = stream_by_time(spark, chunks, "ts")
    closed = run_to_table(replies.assemble_stream_live(stream, 600, "1 hour", block=64), spark)
    return flat(live.whole_replies(closed, chunks))


register("stream_assembly", live_assembly, f"WITH {MESSAGES} {ASSEMBLED}")
register(
    "parse_sse_chunks",
    lambda s, d: times_as_text(
        ops.parse_sse_chunks(inputs.sse_lines(s, d)).select("request_id", "seq", "ts", "delta", "model", "usage.*")
    ),
    f"""WITH {MESSAGES}, w AS (
      SELECT id, created_at, unnest(string_split(content, ' ')) AS word, generate_subscripts(string_split(content, ' '), 1) - 1 AS n
      FROM messages WHERE role = 'assistant')
    SELECT id AS request_id, n * 4 AS seq, {iso('created_at + to_milliseconds(20 * (n + 1))')} AS ts,
      CASE WHEN n = 0 THEN word ELSE ' ' || word END AS delta, CASE WHEN n = 0 THEN 'north/aurora-small' END AS model,
      NULL AS prompt_tokens, NULL AS completion_tokens, NULL AS total_tokens
    FROM w WHERE n > 0 OR word <> ''
    UNION ALL
    SELECT id, len(string_split(content, ' ')) * 4, {iso("created_at + to_milliseconds(20 * (len(string_split(content, ' ')) + 1))")},
      '', NULL, 7, len(string_split(content, ' ')), len(string_split(content, ' ')) + 7 FROM messages WHERE role = 'assistant'""",
)
register(
    "sse_to_reply",
    lambda s, d: flat(ops.assemble_stream(ops.parse_sse_chunks(inputs.sse_lines(s, d)))),
    f"WITH {MESSAGES} {ASSEMBLED}",
)
register(
    "usage_from_payload",
    lambda s, d: inputs.table(s, d, "events")
    .select(
        "event_id",
        ops.payloads(
            F.expr(
                """case event_id % 4 when 0 then concat('{"usage":{"prompt_tokens":', event_id, ',"total_tokens":null}}')
                   when 1 then '{"usage":null}' when 2 then '{}'
                   else concat('{"usage":{"completion_tokens":', event_id, ',"prompt_tokens":0,"total_tokens":', event_id, '}}') end"""
            )
        ).alias("docs"),
    )
    .select("event_id", ops.usage_from_payload(ops.only(F.col("docs"))).alias("u"))
    .select("event_id", "u.*"),
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id ELSE 0 END AS prompt_tokens,
      CASE WHEN event_id % 4 = 3 THEN event_id ELSE 0 END AS completion_tokens,
      CASE WHEN event_id % 4 = 3 THEN event_id ELSE 0 END AS total_tokens FROM events""",
)
register(
    "estimate_prompt",
    lambda s, d: ops.estimate_prompt(inputs.messages(s, d), "conversation_id"),
    f"""WITH {MESSAGES} SELECT conversation_id, CAST(sum(greatest(1, length(content) // 4)) AS BIGINT) AS prompt_tokens
    FROM messages GROUP BY 1""",
)

# One raw call per event: streamed and plain ones through three adapters.
CALL = {
    "request_id": inputs.CALL["request_id"],
    "session_id": inputs.CALL["session_id"],
    "conversation_id": inputs.CALL["conversation_id"],
    "streamed": "event_id % 2 = 0",
    "adapter": "case event_id % 3 when 0 then 'openrouter' when 1 then 'openrouter_with_ollama_fallback' else 'ollama' end",
    "requested_model": inputs.model_of("event_id"),
    "model": f"case when event_id % 5 < 2 then {inputs.model_of('(event_id + 1)')} end",
    "provider": "case when event_type <> 'error' then 'answered' end",
    "status": inputs.CALL["status"],
    "error_type": "if(event_type = 'error', 'RuntimeError', null)",
    "error_message": "if(event_type = 'error', concat('broken for ', user_id), null)",
    "started_at": "cast(ts as timestamp)",
    "first_token_at": "case when event_type in ('view', 'click') then cast(ts as timestamp) + make_dt_interval(0, 0, 0, 0.25) end",
    "ended_at": "cast(ts as timestamp) + make_dt_interval(0, 0, 0, 1.5 + event_id % 7)",
    "usage": f"named_struct('prompt_tokens', {inputs.PROMPT}, 'completion_tokens', {inputs.COMPLETION}, 'total_tokens', {inputs.PROMPT} + {inputs.COMPLETION})",
    "cost_usd": "0.25D",
    "input_text": "concat('mail to a', event_id, '@example.org about ', props)",
    "output_text": "concat('call +1 415 555 ', lpad(event_id % 10000, 4, '0'))",
    "metadata": "case when event_id % 4 = 0 then props end",
}


def finished_calls(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in CALL.items()])


register(
    "call_timing",
    lambda s, d: ops.call_timing(finished_calls(s, d)).select("request_id", "latency_ms", "ttft_ms"),
    f"""WITH {EVENTS} SELECT request_id, 1500.0::DOUBLE + 1000 * (event_id % 7) AS latency_ms,
      CASE WHEN ttft_ms IS NOT NULL THEN 250.0::DOUBLE END AS ttft_ms FROM calls""",
)
_EVENT = ["request_id", "session_id", "conversation_id", "provider", "model", "status", "error_type", "error_message", "latency_ms",
          "ttft_ms", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "input_preview", "output_preview", "redacted",
          "created_at", "metadata"]
_CALLS = f"""
raw AS (
  SELECT *, event_id % 2 = 0 AS streamed, event_id % 2 = 1 AND status <> 'success' AS lost,
    CASE event_id % 3 WHEN 0 THEN 'openrouter' WHEN 1 THEN 'openrouter_with_ollama_fallback' ELSE 'ollama' END AS adapter,
    CASE WHEN event_id % 5 < 2 THEN {model_of('event_id + 1')} ELSE model END AS answered,
    'mail to a' || event_id || '@example.org about ' || props AS input_text,
    'call +1 415 555 ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS output_text
  FROM calls WHERE event_id % 2 = 0 OR status <> 'cancelled'
),
made AS (
  SELECT request_id, session_id, conversation_id,
    CASE WHEN lost THEN adapter WHEN NOT streamed THEN 'answered' WHEN adapter = 'ollama' THEN 'ollama'
         WHEN adapter <> 'openrouter' AND answered = 'slate:14b' THEN 'ollama'
         WHEN contains(answered, '/') THEN split_part(answered, '/', 1) ELSE 'openrouter' END AS provider,
    CASE WHEN lost THEN model ELSE answered END AS model, status,
    CASE WHEN status = 'error' THEN 'RuntimeError' END AS error_type,
    CASE WHEN status = 'error' THEN 'broken for ' || user_id END AS error_message,
    1500.0::DOUBLE + 1000 * (event_id % 7) AS latency_ms, CASE WHEN ttft_ms IS NOT NULL THEN 250.0::DOUBLE END AS ttft_ms,
    CASE WHEN lost THEN 0 ELSE prompt_tokens END AS prompt_tokens,
    CASE WHEN lost THEN 0 ELSE completion_tokens END AS completion_tokens,
    CASE WHEN lost THEN 0 ELSE total_tokens END AS total_tokens,
    CASE WHEN NOT streamed AND NOT lost THEN 0.25::DOUBLE END AS cost_usd,
    input_text AS input_preview, CASE WHEN lost THEN '' ELSE output_text END AS output_preview,
    {iso("date_trunc('millisecond', ts + to_milliseconds(1500 + 1000 * (event_id % 7)))")} AS created_at,
    CASE WHEN event_id % 4 = 0 THEN props ELSE '{{}}' END AS metadata
  FROM raw
)"""
register(
    "build_log_event",
    lambda s, d: times_as_text(ops.build_log_event(finished_calls(s, d), fallback_model="slate:14b").select(*_EVENT)),
    f"WITH {EVENTS}, {_CALLS} SELECT *, false AS redacted FROM made",
)
register(
    "build_log_event_redacted",
    lambda s, d: ops.build_log_event(finished_calls(s, d), redact=True, limit=30).select(
        "request_id", "input_preview", "output_preview", "redacted"
    ),
    f"""WITH {EVENTS}, {_CALLS}, r AS (SELECT request_id, substr(input_preview, 1, 30) AS i, substr(output_preview, 1, 30) AS o,
      {scrubbed("substr(input_preview, 1, 30)", CLIENT_RULES)} AS input_preview,
      {scrubbed("substr(output_preview, 1, 30)", CLIENT_RULES)} AS output_preview FROM made)
    SELECT request_id, input_preview, output_preview, i <> input_preview OR o <> output_preview AS redacted FROM r""",
)


def streamed_calls(spark, sf_dir):
    """The starts of the streamed calls."""
    return inputs.calls(spark, sf_dir).select(
        "request_id", "session_id", "conversation_id", "started_at",
        F.lit("openrouter").alias("adapter"),
        F.col("model").alias("requested_model"),
        F.lit(None).cast("string").alias("provider"),
        F.when(F.col("status") == "complete", "success").otherwise(F.col("status")).alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("error_type", "error_message", "metadata", "input_text")],
        F.lit(None).cast("double").alias("cost_usd"),
    )


def lines_to_events(spark, sf_dir):
    """From the lines of event streams and the calls' starts to log events."""
    chunks = ops.parse_sse_chunks(inputs.sse_lines(spark, sf_dir))
    return times_as_text(ops.build_log_event(ops.finished_streams(streamed_calls(spark, sf_dir), chunks)).select(*_EVENT))


register(
    "sse_lines_to_log_events",
    lines_to_events,
    f"""WITH {MESSAGES}, m AS (SELECT *, len(string_split(content, ' ')) AS n FROM messages WHERE role = 'assistant')
    SELECT id AS request_id, conversation_id AS session_id, conversation_id, 'north' AS provider, 'north/aurora-small' AS model,
      CASE status WHEN 'complete' THEN 'success' ELSE status END AS status, NULL AS error_type, NULL AS error_message,
      20.0::DOUBLE * (n + 1) AS latency_ms, 20.0::DOUBLE * {_LEAD} AS ttft_ms, 7 AS prompt_tokens, n AS completion_tokens,
      n + 7 AS total_tokens, NULL AS cost_usd, '' AS input_preview, substr(content, 1, 500) AS output_preview, false AS redacted,
      {iso('created_at + to_milliseconds(20 * (n + 1))')} AS created_at, '{{}}' AS metadata FROM m""",
)
