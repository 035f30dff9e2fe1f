"""Operators on conversations and messages, as jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.functions import text
from callsight.functions.times import as_time
from callsight.operators.logs import Time, dedup_latest, in_range, spread
from callsight.schemas import CONVERSATION_STATUSES

# Messages sent along with a turn, page sizes, the model when none is asked for.
CONTEXT_MESSAGES = 20
PAGE, MAX_PAGE = 50, 200
DEFAULT_MODEL = "openai/gpt-4o-mini"

FAR_PAST, FAR_FUTURE = "0001-01-01", "9999-12-31"


# --- reading --------------------------------------------------------------------------


def by_status(conversations: DataFrame, status: str | None = None) -> DataFrame:
    if status is None:
        return conversations
    if status not in CONVERSATION_STATUSES:
        raise ValueError(f"status must be one of {', '.join(CONVERSATION_STATUSES)}, not {status!r}")
    return conversations.where(F.col("status") == status)


def by_key(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    """The rows of one key; none when it is unknown."""
    return df.where(F.col(column) == key)


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}, not {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative, as {offset} is")


def list_projection(conversations: DataFrame) -> DataFrame:
    """A conversation without its messages."""
    return conversations.select("id", "title", "status", "model", "message_count", "created_at", "updated_at")


def message_count(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.count("id").alias("message_count"))


def with_message_count(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """All conversations with the number of their messages, 0 for none."""
    counts = message_count(messages).withColumnRenamed("conversation_id", "id")
    return conversations.join(counts, "id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0))
    )


def list_conversations(
    conversations: DataFrame, messages: DataFrame, status: str | None = None, limit: int = PAGE, offset: int = 0
) -> DataFrame:
    """One page, most recently active first, ties by id.

    The page is cut first. It has at most 200 rows, so it is broadcast, and only its
    own messages are counted.
    """
    check_page(limit, offset)
    page = (
        by_status(conversations, status).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)
    )
    ids = F.broadcast(page.select(F.col("id").alias("conversation_id")))
    listed = with_message_count(page, messages.join(ids, "conversation_id", "left_semi"))
    return list_projection(listed).orderBy(F.desc("updated_at"), "id")


def conversation_detail(conversations: DataFrame, messages: DataFrame, ordered: bool = True) -> DataFrame:
    """Conversations with their messages: a row per message, oldest first within the
    conversation, and one row with null message columns where there are none.

    Messages are the driving side of the join, so a conversation with very many of them can
    be split. With `ordered` the whole answer is sorted by ranges, which can cut through one;
    without, the rows of a conversation come in any order and nothing is sorted.
    """
    conv = conversations.select(
        F.col("id").alias("conversation_id"),
        "title",
        F.col("status").alias("conversation_status"),
        "model",
        F.col("created_at").alias("conversation_created_at"),
        "updated_at",
    )
    seen = messages.select("conversation_id").distinct()
    empty = conv.join(seen, "conversation_id", "left_anti")
    full = messages.withColumnRenamed("id", "message_id").join(conv, "conversation_id")
    rows = full.unionByName(empty, allowMissingColumns=True)
    return rows.orderBy("conversation_id", "created_at", "message_id") if ordered else rows


def detail_projection(detail: DataFrame) -> DataFrame:
    """The message columns of an opened conversation."""
    return detail.select(
        "conversation_id",
        "title",
        "conversation_status",
        "model",
        "message_id",
        "role",
        "content",
        "status",
        "prompt_tokens",
        "completion_tokens",
        "request_id",
        "created_at",
    )


# The fields of a message in a nested conversation.
MESSAGE_FIELDS = ["id", "role", "content", "status", "prompt_tokens", "completion_tokens", "request_id", "created_at"]
NESTED_BLOCK_SECONDS = 3600


def conversation_nested(
    conversations: DataFrame, messages: DataFrame, block_seconds: int = NESTED_BLOCK_SECONDS
) -> DataFrame:
    """One row per conversation with its messages as an array, oldest first, equal times by id.

    The answer's shape, for conversations that fit a row; `conversation_detail` has any. Messages
    are listed and sorted by blocks of time first, so the tasks of a conversation with very many
    of them share that work and only lists are put behind each other at the end.
    """
    block = F.floor(F.unix_seconds("created_at") / block_seconds)
    entry = F.struct("created_at", "id", F.struct(*MESSAGE_FIELDS).alias("message"))
    blocks = messages.groupBy("conversation_id", block.alias("_block")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["message"]).alias("_part")
    )
    lists = blocks.groupBy("conversation_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_part"))), lambda x: x["_part"])).alias("messages")
    )
    found = conversations.join(lists, F.col("id") == F.col("conversation_id"), "left").drop("conversation_id")
    return found.withColumn("messages", F.coalesce("messages", F.array().cast(lists.schema["messages"].dataType)))


def context(messages: DataFrame, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """The last n messages of each conversation, oldest first, as an array.

    Every task first cuts its part of a conversation down to n.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    last = messages.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content")))
    return last.groupBy("conversation_id").agg(
        F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )


def recent(messages: DataFrame, conversation_id: str, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """The last n messages of one conversation, oldest first."""
    last = by_key(messages, conversation_id, "conversation_id").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return last.orderBy("created_at", "id")


def last_user_text(messages: DataFrame) -> DataFrame:
    """The last user message of each conversation, '' when there is none."""
    order = F.when(F.col("role") == "user", F.struct("created_at", "id"))
    return messages.groupBy("conversation_id").agg(text.blank(F.max_by("content", order)).alias("last_user_text"))


def last_user_in(context_messages: Column) -> Column:
    """The same from an array of messages."""
    users = F.filter(context_messages, lambda m: m["role"] == "user")
    return text.blank(F.try_element_at(users, F.lit(-1))["content"])


# --- with the log table ---------------------------------------------------------------


def one_per_request(logs: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """The latest row of each request. A request id belongs to one call, so this also
    removes redelivered copies. With `messages`, only their requests are looked at: the
    others leave before copies are removed."""
    logs = spread(logs, "request_id")
    if messages is not None:
        wanted = spread(_asked(messages).select("request_id"), "request_id").distinct()
        logs = logs.join(wanted, ["request_id", "_slot"], "left_semi")
    return dedup_latest(logs, ["request_id", "_slot"], ties=["created_at"]).drop("_slot")


def _between(logs: DataFrame, since: Time | None, until: Time | None) -> DataFrame:
    return in_range(logs, since or FAR_PAST, until or FAR_FUTURE) if since or until else logs


def _asked(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("request_id").isNotNull())


def trace_messages(
    messages: DataFrame, logs: DataFrame, since: Time | None = None, until: Time | None = None
) -> DataFrame:
    """Each message with the provider, state and timing of the call that made it, looked up
    among the logs of a time range.

    Messages without a request id skip the join: as equal nulls they would all meet in
    one task.
    """
    calls = one_per_request(_between(logs, since, until), messages).select(
        "request_id",
        F.lit(True).alias("has_log"),
        "provider",
        F.col("model").alias("log_model"),
        F.col("status").alias("log_status"),
        "latency_ms",
        "ttft_ms",
    )
    traced = _asked(messages).join(calls, "request_id", "left")
    rest = messages.where(F.col("request_id").isNull())
    both = traced.unionByName(rest, allowMissingColumns=True)
    return both.withColumn("has_log", F.coalesce("has_log", F.lit(False)))


def messages_without_log(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Answers whose log row was lost on the way."""
    logged = spread(logs.select("request_id"), "request_id").distinct()
    return _asked(messages).join(logged.drop("_slot"), "request_id", "left_anti")


def conversation_logs(conversations: DataFrame, logs: DataFrame) -> DataFrame:
    """Calls, failures and tokens of each conversation, zeros for none."""
    used = (
        logs.where(F.col("conversation_id") != "")
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.sum("total_tokens").alias("tokens"),
        )
    )
    return (
        conversations.select("id")
        .join(used, "id", "left")
        .select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "errors", "tokens")])
    )


def conversation_model(
    conversations: DataFrame,
    messages: DataFrame,
    logs: DataFrame,
    since: Time | None = None,
    until: Time | None = None,
) -> DataFrame:
    """Conversations with `model` set to the model that answered last, looked up among the
    logs of a time range."""
    models = one_per_request(_between(logs, since, until), messages).select("request_id", F.col("model").alias("_answered"))
    last = (
        _asked(messages)
        .join(models, "request_id")
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.max_by("_answered", F.struct(F.col("created_at"), F.col("id"))).alias("_answered"))
    )
    return (
        conversations.join(last, "id", "left").withColumn("model", F.coalesce("_answered", "model")).drop("_answered")
    )


# --- changing -------------------------------------------------------------------------


def gate_turns(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Adds a verdict to each turn: ok, new (no conversation yet), not_found, closed
    (not active) or empty (no text).

    Turns without a conversation skip the join, as equal nulls would meet in one task.
    """
    known = conversations.select(F.col("id").alias("conversation_id"), F.col("status").alias("_status"))
    fresh = turns.where(F.col("conversation_id").isNull()).withColumn("_status", F.lit("new"))
    old = turns.where(F.col("conversation_id").isNotNull()).join(known, "conversation_id", "left")
    verdict = (
        F.when(F.coalesce(F.length("message"), F.lit(0)) < 1, "empty")
        .when(F.col("_status") == "new", "new")
        .when(F.col("_status") == "active", "ok")
        .when(F.col("_status").isNull(), "not_found")
        .otherwise("closed")
    )
    return old.unionByName(fresh).withColumn("verdict", verdict).drop("_status")


def accepted(gated: DataFrame) -> DataFrame:
    """Turns that go on, with the id of their conversation. A new conversation's id is
    derived from its first turn, so running the job again makes no second one."""
    return gated.where(F.col("verdict").isin("ok", "new")).withColumn(
        "conversation_id", F.coalesce("conversation_id", F.md5("turn_id"))
    )


def new_conversations(gated: DataFrame, default_model: str = DEFAULT_MODEL) -> DataFrame:
    """The conversations that turns without one begin."""
    return accepted(gated.where(F.col("verdict") == "new")).select(
        F.col("conversation_id").alias("id"),
        text.title(F.col("message")).alias("title"),
        F.lit("active").alias("status"),
        F.coalesce(text.missing_if_blank(F.col("model")), F.lit(default_model)).alias("model"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def append_turns(messages: DataFrame, turns: DataFrame, results: DataFrame, streamed: bool = True) -> DataFrame:
    """Messages with the accepted turns and the answers to them.

    Streamed answers are kept with the state of their call, others are complete.
    """
    asked = turns.select(
        F.md5(F.concat(F.lit("user/"), F.col("turn_id"))).alias("id"),
        "conversation_id",
        F.lit("user").alias("role"),
        F.col("message").alias("content"),
        F.lit("complete").alias("status"),
        "created_at",
    )
    state = text.message_status(F.col("status")) if streamed else F.lit("complete")
    answered = results.join(turns.select("turn_id", "conversation_id"), "turn_id").select(
        F.md5(F.concat(F.lit("assistant/"), F.col("turn_id"))).alias("id"),
        "conversation_id",
        F.lit("assistant").alias("role"),
        F.col("text").alias("content"),
        state.alias("status"),
        "prompt_tokens",
        "completion_tokens",
        "request_id",
        "created_at",
    )
    return messages.unionByName(asked, allowMissingColumns=True).unionByName(answered)


def apply_cancels(conversations: DataFrame, cancels: DataFrame, as_of: Time) -> DataFrame:
    """A new snapshot: active conversations named in `cancels` are cancelled, the rest
    stays. Cancelling twice changes nothing."""
    named = cancels.select("id").distinct().withColumn("_named", F.lit(True))
    hit = F.col("_named") & (F.col("status") == "active")
    return (
        conversations.join(named, "id", "left")
        .withColumn("_hit", F.coalesce(hit, F.lit(False)))
        .withColumns(
            {
                "status": F.when(F.col("_hit"), "cancelled").otherwise(F.col("status")),
                "updated_at": F.when(F.col("_hit"), as_time(as_of)).otherwise(F.col("updated_at")),
            }
        )
        .drop("_named", "_hit")
    )


def unknown_cancels(conversations: DataFrame, cancels: DataFrame) -> DataFrame:
    """Ids to cancel that no conversation has."""
    return cancels.select("id").distinct().join(conversations.select("id"), "id", "left_anti")


def cascade_delete(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The messages whose conversation still exists."""
    ids = conversations.select(F.col("id").alias("conversation_id"))
    return messages.join(ids, "conversation_id", "left_semi")
