"""SQL for the inputs: the derivations of `checks/inputs.py` over the same tables."""

from __future__ import annotations

from checks.inputs import AS_OF, MODELS

_MODELS = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"


def model_of(expr: str) -> str:
    return f"{_MODELS}[CAST(({expr}) % 6 + 1 AS INTEGER)]"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g')"


EVENTS = f"""
calls AS (
  SELECT event_id, ts, user_id, props,
    'req_' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS request_id,
    's' || user_id AS session_id,
    'c' || (event_id // 8) AS conversation_id,
    {model_of('event_id')} AS model,
    CASE WHEN event_id % 6 < 4 THEN split_part({model_of('event_id')}, '/', 1) ELSE 'ollama' END AS provider,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancelled' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' THEN 'TimeoutError' ELSE '' END AS error_type,
    CASE WHEN event_type = 'error' THEN 'no answer to user ' || user_id ELSE '' END AS error_message,
    value * 10 AS latency_ms,
    CASE WHEN event_type IN ('view', 'click') THEN value * 2 END AS ttft_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens,
    CAST(floor(value) AS BIGINT) AS completion_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens,
    CASE WHEN event_id % 6 < 4
      THEN (CAST(json_extract_string(props, '$.k') AS BIGINT) + CAST(floor(value) AS BIGINT)) * CAST(1e-6 AS DOUBLE) END AS cost_usd,
    date_trunc('millisecond', ts) AS created_at,
    date_trunc('millisecond', ts + INTERVAL 1 SECOND) AS first_arrival,
    date_trunc('millisecond', ts + INTERVAL 6 SECOND) AS second_arrival
  FROM events
),
raw_logs AS (
  SELECT *, first_arrival AS ingested_at FROM calls
  UNION ALL
  SELECT *, second_arrival AS ingested_at FROM calls WHERE event_id % 10 = 0
),
logs AS (
  SELECT * EXCLUDE (rank) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY created_at, provider, model, request_id ORDER BY ingested_at DESC) AS rank
    FROM raw_logs) WHERE rank = 1
)"""

MESSAGES = fr"""
messages AS (
  SELECT 'm' || conv_id || '_' || turn AS id, 'c' || conv_id AS conversation_id, role, text AS content,
    CASE WHEN role = 'assistant' AND (conv_id + turn) % 17 = 0 THEN 'error'
         WHEN role = 'assistant' AND (conv_id + turn) % 19 = 0 THEN 'cancelled' ELSE 'complete' END AS status,
    CASE WHEN role = 'assistant' THEN turn * 10 END AS prompt_tokens,
    CASE WHEN role = 'assistant' THEN greatest(1, CAST(length(text) AS BIGINT) // 4) END AS completion_tokens,
    CASE WHEN role = 'assistant' THEN
      CASE WHEN conv_id % 10 = 9 THEN 'lost_' || (conv_id * 8 + turn)
           ELSE 'req_' || lpad(CAST(conv_id * 8 + turn AS VARCHAR), 10, '0') END END AS request_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at,
    conv_id, turn
  FROM conversations
),
convs AS (
  SELECT conversation_id AS id,
    regexp_replace(replace(regexp_replace(arg_min(content, created_at) FILTER (role = 'user'), '^\s+|\s+$', '', 'g'), chr(10), ' '),
      '^(.{{60}}).+$', '\1…') AS title,
    CASE conv_id % 5 WHEN 3 THEN 'cancelled' WHEN 4 THEN 'archived' ELSE 'active' END AS status,
    '{MODELS[0]}' AS model, min(created_at) AS created_at, max(created_at) AS updated_at
  FROM messages GROUP BY conversation_id, conv_id
  UNION ALL
  SELECT 'empty' || n, NULL, 'active', NULL, TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2023-12-31 00:00:00'
  FROM range(3) r(n)
)"""


def window(hours: int, source: str = "logs") -> str:
    return f"(SELECT * FROM {source} WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR)"


def quantile(p: float, column: str = "latency_ms") -> str:
    return f"quantile_cont({column}, {p})"


def rounded(expr: str, digits: int = 0) -> str:
    return f"round_even({expr}, {digits})"


def whole(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


def zero(expr: str) -> str:
    return f"COALESCE({whole(expr)}, 0)"
