"""Conversations and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from callsight.operators import conversations as ops
from callsight.operators.logs import dedup_latest
from callsight.session import scratch_path
from callsight.sources import chat
from checks import inputs
from checks.metrics_queries import times_as_text
from checks.sql import EVENTS, MESSAGES, iso, model_of

QUERIES, SQL = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def both(spark, sf_dir):
    return inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir)


COUNTED = f"""SELECT id, title, status, model, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at,
  (SELECT count(*) FROM messages m WHERE m.conversation_id = c.id) AS message_count FROM convs c"""

register(
    "message_counts",
    lambda s, d: times_as_text(ops.list_projection(ops.with_message_count(*both(s, d)))),
    f"WITH {MESSAGES} {COUNTED}",
)
register(
    "conversation_list_page",
    lambda s, d: times_as_text(ops.list_conversations(*both(s, d), limit=20, offset=10)),
    f"WITH {MESSAGES} {COUNTED} ORDER BY c.updated_at DESC, id LIMIT 20 OFFSET 10",
)
register(
    "conversation_list_by_status",
    lambda s, d: times_as_text(ops.list_conversations(*both(s, d), status="active")),
    f"WITH {MESSAGES} {COUNTED} WHERE status = 'active' ORDER BY c.updated_at DESC, id LIMIT 50",
)
_DETAIL = ["conversation_id", "title", "conversation_status", "model", "message_id", "role", "content", "status",
           "prompt_tokens", "completion_tokens", "request_id", "created_at"]
_DETAIL_SQL = f"""SELECT c.id AS conversation_id, title, c.status AS conversation_status, model, m.id AS message_id, role,
  content, m.status, prompt_tokens, completion_tokens, request_id, {iso('m.created_at')} AS created_at
  FROM convs c LEFT JOIN messages m ON m.conversation_id = c.id"""
register(
    "conversation_detail",
    lambda s, d: times_as_text(ops.detail_projection(ops.conversation_detail(*both(s, d), ordered=False))),
    f"WITH {MESSAGES} {_DETAIL_SQL}",
)
register(
    "conversation_nested",
    lambda s, d: times_as_text(
        ops.conversation_nested(*both(s, d)).select(
            "id", "title", "status", "created_at", "updated_at",
            F.size("messages").alias("n"),
            F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["id"], m["role"], m["status"], m["request_id"], m["content"])), "\n").alias("messages"),
        )
    ),
    f"""WITH {MESSAGES}, l AS (SELECT conversation_id, count(*) AS n,
      string_agg(concat_ws('|', id, role, status, request_id, content), chr(10) ORDER BY created_at, id) AS messages FROM messages GROUP BY 1)
    SELECT c.id, title, status, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at, CAST(COALESCE(n, 0) AS INTEGER) AS n,
      COALESCE(messages, '') AS messages FROM convs c LEFT JOIN l ON c.id = l.conversation_id""",
)
register(
    "conversation_open",
    lambda s, d: times_as_text(
        ops.detail_projection(
            ops.conversation_detail(
                ops.by_key(inputs.conversations(s, d), "c7"), ops.by_key(inputs.messages(s, d), "c7", "conversation_id")
            )
        )
    ),
    f"WITH {MESSAGES} {_DETAIL_SQL} WHERE c.id = 'c7'",
)


def context_rows(n):
    def query(spark, sf_dir):
        lists = ops.context(inputs.messages(spark, sf_dir), n)
        return lists.select("conversation_id", F.posexplode("messages").alias("position", "m")).select(
            "conversation_id", "position", "m.role", "m.content"
        )

    return query


_CONTEXT = """WITH {messages}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS k
  FROM messages)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS position, role, content
FROM r WHERE k <= {n}"""
register("context_last_20", context_rows(20), _CONTEXT.format(messages=MESSAGES, n=20))
register("context_last_3", context_rows(3), _CONTEXT.format(messages=MESSAGES, n=3))
register(
    "recent_messages",
    lambda s, d: times_as_text(ops.recent(inputs.messages(s, d), "c5", 4).select("id", "role", "content", "created_at")),
    f"WITH {MESSAGES} SELECT id, role, content, {iso('created_at')} AS created_at FROM messages "
    "WHERE conversation_id = 'c5' ORDER BY messages.created_at DESC, id DESC LIMIT 4",
)
register(
    "last_user_text",
    lambda s, d: ops.last_user_text(inputs.messages(s, d)),
    f"""WITH {MESSAGES} SELECT conversation_id,
      COALESCE(arg_max(content, created_at) FILTER (role = 'user'), '') AS last_user_text FROM messages GROUP BY 1""",
)
register(
    "last_user_text_in_context",
    lambda s, d: ops.context(inputs.messages(s, d), 2).select(
        "conversation_id", ops.last_user_in(F.col("messages")).alias("last_user_text")
    ),
    f"""WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS k
      FROM messages)
    SELECT conversation_id, COALESCE(arg_max(content, created_at) FILTER (role = 'user'), '') AS last_user_text
    FROM r WHERE k <= 2 GROUP BY 1""",
)
register(
    "conversation_model",
    lambda s, d: ops.conversation_model(*both(s, d), inputs.raw_logs(s, d)).select("id", "model"),
    f"""WITH {EVENTS}, {MESSAGES}, a AS (
      SELECT m.conversation_id, arg_max(l.model, m.created_at) AS answered
      FROM messages m JOIN logs l USING (request_id) GROUP BY 1)
    SELECT id, COALESCE(answered, model) AS model FROM convs LEFT JOIN a ON conversation_id = id""",
)
register(
    "message_status",
    lambda s, d: inputs.raw_logs(s, d).groupBy("request_id").agg(F.any_value("status").alias("status")).select(
        "request_id", ops.text.message_status(F.col("status")).alias("status")
    ),
    f"""WITH {EVENTS} SELECT request_id, CASE status WHEN 'success' THEN 'complete' ELSE status END AS status FROM calls""",
)
register(
    "trace_messages",
    lambda s, d: ops.trace_messages(inputs.messages(s, d), inputs.raw_logs(s, d)).select(
        "id", "request_id", "has_log", "provider", "log_model", "log_status", "latency_ms", "ttft_ms"
    ),
    f"""WITH {EVENTS}, {MESSAGES}
    SELECT m.id, m.request_id, l.request_id IS NOT NULL AS has_log, l.provider, l.model AS log_model, l.status AS log_status,
      l.latency_ms, l.ttft_ms FROM messages m LEFT JOIN logs l ON l.request_id = m.request_id""",
)
register(
    "messages_without_log",
    lambda s, d: ops.messages_without_log(inputs.messages(s, d), inputs.raw_logs(s, d)).select("id", "request_id"),
    f"""WITH {EVENTS}, {MESSAGES} SELECT id, request_id FROM messages
    WHERE request_id IS NOT NULL AND request_id NOT IN (SELECT request_id FROM logs)""",
)
register(
    "conversation_logs",
    lambda s, d: ops.conversation_logs(inputs.conversations(s, d), dedup_latest(inputs.raw_logs(s, d))),
    f"""WITH {EVENTS}, {MESSAGES}
    SELECT id, count(request_id) AS calls, count(request_id) FILTER (l.status = 'error') AS errors,
      CAST(COALESCE(sum(total_tokens), 0) AS BIGINT) AS tokens
    FROM convs c LEFT JOIN logs l ON l.conversation_id = c.id GROUP BY id""",
)


def gated(spark, sf_dir):
    return ops.gate_turns(inputs.turns(spark, sf_dir), inputs.conversations(spark, sf_dir))


TURNS = f"""
turns AS (
  SELECT 't' || conv_id || '_' || turn AS turn_id, conv_id, turn,
    CASE WHEN turn = 0 THEN NULL WHEN conv_id % 7 = 0 THEN 'gone' || conv_id ELSE 'c' || conv_id END AS conversation_id,
    text AS message, CASE WHEN conv_id % 2 = 0 THEN {model_of('conv_id')} END AS model,
    TIMESTAMP '2024-02-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at
  FROM conversations WHERE role = 'user'
),
gated AS (
  SELECT t.* REPLACE (COALESCE(t.conversation_id, md5(turn_id)) AS conversation_id),
    CASE WHEN length(message) < 1 THEN 'empty' WHEN t.conversation_id IS NULL THEN 'new' WHEN c.status = 'active' THEN 'ok'
         WHEN c.status IS NULL THEN 'not_found' ELSE 'closed' END AS verdict
  FROM turns t LEFT JOIN convs c ON c.id = t.conversation_id
)"""
register(
    "gate_turns",
    lambda s, d: gated(s, d).select("turn_id", "conversation_id", "verdict"),
    f"WITH {MESSAGES}, {TURNS} SELECT turn_id, CASE WHEN verdict <> 'new' THEN conversation_id END AS conversation_id, verdict FROM gated",
)
register(
    "new_conversations",
    lambda s, d: times_as_text(ops.new_conversations(gated(s, d))),
    rf"""WITH {MESSAGES}, {TURNS}, t AS (
      SELECT *, replace(regexp_replace(message, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS line FROM gated WHERE verdict = 'new')
    SELECT conversation_id AS id, CASE WHEN length(line) > 60 THEN substr(line, 1, 60) || '…' ELSE line END AS title,
      'active' AS status, COALESCE(model, 'openai/gpt-4o-mini') AS model, {iso('created_at')} AS created_at,
      {iso('created_at')} AS updated_at FROM t""",
)
register(
    "append_turns",
    lambda s, d: times_as_text(
        ops.append_turns(inputs.messages(s, d), ops.accepted(gated(s, d)), inputs.results(s, d))
    ),
    f"""WITH {MESSAGES}, {TURNS}, ok AS (SELECT * FROM gated WHERE verdict IN ('ok', 'new'))
    SELECT id, conversation_id, role, content, status, prompt_tokens, completion_tokens, request_id, {iso('created_at')} AS created_at
    FROM messages
    UNION ALL SELECT md5('user/' || turn_id), conversation_id, 'user', message, 'complete', NULL, NULL, NULL, {iso('created_at')} FROM ok
    UNION ALL SELECT md5('assistant/' || turn_id), conversation_id, 'assistant', reverse(message),
      CASE WHEN (conv_id + turn) % 11 = 0 THEN 'error' WHEN (conv_id + turn) % 13 = 0 THEN 'cancelled' ELSE 'complete' END,
      length(message), turn + 1, 'req_new_' || conv_id || '_' || turn, {iso("created_at + INTERVAL 30 SECOND")} FROM ok""",
)
CANCELS = """cancels AS (SELECT DISTINCT CASE WHEN conv_id % 9 = 0 THEN 'gone' || conv_id ELSE 'c' || (conv_id - conv_id % 3) END AS id
  FROM conversations WHERE role = 'user')"""
register(
    "apply_cancels",
    lambda s, d: times_as_text(
        ops.apply_cancels(inputs.conversations(s, d), inputs.cancels(s, d), inputs.AS_OF).select("id", "status", "updated_at")
    ),
    f"""WITH {MESSAGES}, {CANCELS}
    SELECT id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status,
      {iso(f"CASE WHEN hit THEN TIMESTAMP '{inputs.AS_OF}' ELSE updated_at END")} AS updated_at
    FROM (SELECT *, status = 'active' AND id IN (SELECT id FROM cancels) AS hit FROM convs)""",
)
register(
    "unknown_cancels",
    lambda s, d: ops.unknown_cancels(inputs.conversations(s, d), inputs.cancels(s, d)),
    f"WITH {MESSAGES}, {CANCELS} SELECT id FROM cancels WHERE id NOT IN (SELECT id FROM convs)",
)
register(
    "cascade_delete",
    lambda s, d: ops.cascade_delete(
        inputs.messages(s, d), inputs.conversations(s, d).where("status <> 'archived'")
    ).select("id", "conversation_id"),
    f"""WITH {MESSAGES} SELECT id, conversation_id FROM messages
    WHERE conversation_id IN (SELECT id FROM convs WHERE status <> 'archived')""",
)


def snapshot(spark, sf_dir):
    """The chat tables written as a snapshot and read back."""
    path = scratch_path(spark, "chat")
    chat.write_chat(*both(spark, sf_dir), path)
    return times_as_text(ops.with_message_count(*chat.read_chat(spark, path)))


register("chat_snapshot", snapshot, SQL["message_counts"])
