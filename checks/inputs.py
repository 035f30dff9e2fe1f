"""The engine's input tables, derived by Spark from the given test tables.

`checks/sql.py` holds the same derivations for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.text import blank, preview, title
from callsight.functions.times import to_millis

AS_OF = "2024-01-31 00:00:00"
RANGE = ("2024-01-24 00:00:00", "2024-01-31 00:00:00")
MODELS = [
    "north/aurora-small",
    "east/comet-2.1",
    "south/delta-quick",
    "west/ember-chat",
    "slate:14b",
    "slate:8b",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_tasks(rows: DataFrame) -> DataFrame:
    """Rows of a file of few parts dealt to more tasks, by their bytes: what is made of them costs far more
    than the rows."""
    return rows.hint("rebalance")


_MODELS = "array(" + ", ".join(f"'{m}'" for m in MODELS) + ")"


def model_of(number: str) -> str:
    return f"element_at({_MODELS}, cast({number} % 6 + 1 as int))"


# A log row out of an events row, without previews.
PROMPT = "cast(get_json_object(props, '$.k') as bigint)"
COMPLETION = "cast(floor(value) as bigint)"
CREATED = "date_trunc('MILLISECOND', cast(ts as timestamp))"
CALL = {
    "request_id": "concat('req_', lpad(event_id, 10, '0'))",
    "session_id": "concat('s', user_id)",
    "conversation_id": "concat('c', event_id div 8)",
    "provider": f"if(event_id % 6 < 4, split_part({model_of('event_id')}, '/', 1), 'ollama')",
    "model": model_of("event_id"),
    "status": "case event_type when 'error' then 'error' when 'signup' then 'cancelled' else 'success' end",
    "error_type": "if(event_type = 'error', 'TimeoutError', '')",
    "error_message": "if(event_type = 'error', concat('no answer to user ', user_id), '')",
    "latency_ms": "value * 10",
    "ttft_ms": "case when event_type in ('view', 'click') then value * 2 end",
    "prompt_tokens": PROMPT,
    "completion_tokens": COMPLETION,
    "total_tokens": f"{PROMPT} + {COMPLETION}",
    "cost_usd": f"case when event_id % 6 < 4 then ({PROMPT} + {COMPLETION}) * 1e-6D end",
    "input_preview": "''",
    "output_preview": "''",
    "redacted": "0",
    "created_at": CREATED,
    "metadata": "props",
}


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log table before copies are removed: every tenth call was delivered twice."""
    calls = table(spark, sf_dir, "events").selectExpr(
        "*", "explode(if(event_id % 10 = 0, array(1, 6), array(1))) as late"
    )
    arrived = "date_trunc('MILLISECOND', cast(ts as timestamp) + make_dt_interval(0, 0, 0, late)) as ingested_at"
    return calls.selectExpr(*[f"{e} as {n}" for n, e in CALL.items()], arrived)


def logs_with_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call; the call's document is its input, the document's language part its output."""
    events, documents = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    texts = documents.select(F.col("doc_id").alias("event_id"), "text", "source")
    calls = events.join(texts, "event_id", "left")
    columns = {n: F.expr(e) for n, e in CALL.items()} | {
        "input_preview": preview(F.col("text")),
        "output_preview": blank(F.col("source")),
    }
    return calls.select(*[c.alias(n) for n, c in columns.items()])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = "concat('req_', lpad(conv_id * 8 + turn, 10, '0'))"
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat('m', conv_id, '_', turn) as id",
        "concat('c', conv_id) as conversation_id",
        "role",
        "text as content",
        """case when role = 'assistant' and (conv_id + turn) % 17 = 0 then 'error'
             when role = 'assistant' and (conv_id + turn) % 19 = 0 then 'cancelled' else 'complete' end as status""",
        "case when role = 'assistant' then turn * 10 end as prompt_tokens",
        "case when role = 'assistant' then greatest(1L, length(text) div 4) end as completion_tokens",
        f"""case when role = 'assistant' then
             if(conv_id % 10 = 9, concat('lost_', conv_id * 8 + turn), {request}) end as request_id""",
        "timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60) as created_at",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation of the table, and three without messages."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    msg = messages(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("bigint")
    made = (
        msg.groupBy(F.col("conversation_id").alias("id"))
        .agg(
            F.min_by("content", F.when(F.col("role") == "user", F.col("created_at"))).alias("_first"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
        )
        .select(
            "id",
            title(F.col("_first")).alias("title"),
            F.when(number % 5 == 3, "cancelled").when(number % 5 == 4, "archived").otherwise("active").alias("status"),
            F.lit(MODELS[0]).alias("model"),
            "created_at",
            "updated_at",
        )
    )
    start = F.lit("2023-12-31 00:00:00").cast("timestamp")
    empty = spark.range(3).select(
        F.concat(F.lit("empty"), F.col("id")).alias("id"),
        F.lit(None).cast("string").alias("title"),
        F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("model"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )
    return made.unionByName(empty)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns to be answered: to known, unknown and new conversations."""
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .selectExpr(
            "concat('t', conv_id, '_', turn) as turn_id",
            """case when turn = 0 then null when conv_id % 7 = 0 then concat('gone', conv_id)
                 else concat('c', conv_id) end as conversation_id""",
            "text as message",
            f"case when conv_id % 2 = 0 then {model_of('conv_id')} end as model",
            "timestamp_seconds(1706745600 + conv_id * 3600 + turn * 60) as created_at",
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's answers to the turns."""
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .selectExpr(
            "concat('t', conv_id, '_', turn) as turn_id",
            "concat('req_new_', conv_id, '_', turn) as request_id",
            "reverse(text) as text",
            f"{model_of('(conv_id + turn)')} as model",
            """case when (conv_id + turn) % 11 = 0 then 'error' when (conv_id + turn) % 13 = 0 then 'cancelled'
                 else 'success' end as status""",
            "cast(length(text) as bigint) as prompt_tokens",
            "turn + 1 as completion_tokens",
            "timestamp_seconds(1706745600 + conv_id * 3600 + turn * 60 + 30) as created_at",
        )
    )


def cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to cancel a conversation, some repeated, some to unknown ones."""
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .selectExpr("if(conv_id % 9 = 0, concat('gone', conv_id), concat('c', conv_id - conv_id % 3)) as id")
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One streamed call per assistant message."""
    msg = messages(spark, sf_dir).where("role = 'assistant'")
    return msg.select(
        F.col("id").alias("request_id"),
        F.col("conversation_id").alias("session_id"),
        "conversation_id",
        F.lit("slate:8b").alias("model"),
        F.col("created_at").alias("started_at"),
        "content",
        "status",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant message word by word, 20 ms apart, then a piece with the usage."""
    pieces = F.split("content", " ", -1)
    words = F.transform(
        pieces,
        lambda w, i: F.struct(
            i.cast("bigint").alias("seq"),
            F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)).alias("delta"),
            F.lit(None).cast("struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>").alias("usage"),
            F.when(i == 0, F.lit(MODELS[0])).alias("model"),
        ),
    )
    count = F.size(pieces).cast("bigint")
    last = F.struct(
        count.alias("seq"),
        F.lit("").alias("delta"),
        F.struct(
            F.lit(7).cast("bigint").alias("prompt_tokens"),
            count.alias("completion_tokens"),
            (count + 7).alias("total_tokens"),
        ).alias("usage"),
        F.lit(None).cast("string").alias("model"),
    )
    piece = F.explode(F.concat(words, F.array(last)))
    rows = over_tasks(calls(spark, sf_dir)).select("request_id", "started_at", piece.alias("p"))
    return rows.select(
        "request_id",
        "p.seq",
        F.timestamp_millis(F.unix_millis("started_at") + (F.col("p.seq") + 1) * 20).alias("ts"),
        "p.delta",
        "p.usage",
        "p.model",
    )


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as lines of an event stream, with noise, an end mark and lines after it."""
    rows = chunks(spark, sf_dir)
    body = F.to_json(
        F.struct(
            "model",
            F.array(F.struct(F.struct(F.col("delta").alias("content")).alias("delta"))).alias("choices"),
            "usage",
        )
    )
    last = F.col("usage").isNotNull()
    texts = F.when(
        last,
        F.array(F.concat(F.lit("data:"), body), F.lit("data: [DONE]"), F.concat(F.lit("data: "), body)),
    ).otherwise(
        F.array(
            F.concat(F.lit("data: "), body, F.lit("  ")),
            F.lit(""),
            F.lit(": ping"),
            F.when(F.col("seq") % 10 == 3, "data: {cut").otherwise("event: x"),
        )
    )
    lines = rows.select("request_id", "seq", "ts", F.posexplode(texts).alias("n", "line"))
    return lines.select("request_id", (F.col("seq") * 4 + F.col("n")).alias("seq"), "ts", "line")


# How the wire event of each kind (event_id % 40) differs from a clean one. Kinds 6, 7, 10,
# 11, 12, 14, 18 and 19 are odd but valid.
DAMAGE = {
    1: """regexp_replace(body, '"model":"[^"]*",', '')""",
    2: """regexp_replace(body, '"status":"[a-z]+"', '"status":"weird"')""",
    3: """regexp_replace(body, '"latency_ms":[0-9.E-]+', '"latency_ms":null')""",
    4: """regexp_replace(body, '"metadata":[^}]*[}]', '"metadata":[1]')""",
    5: """regexp_replace(body, '"provider":"[^"]*"', '"provider":5')""",
    6: """regexp_replace(body, '"prompt_tokens":([0-9]+)', '"prompt_tokens":" $1 "')""",
    7: """regexp_replace(body, '"prompt_tokens":([0-9]+)', '"prompt_tokens":$1.0')""",
    8: """regexp_replace(body, '"prompt_tokens":([0-9]+)', '"prompt_tokens":$1.5')""",
    9: """regexp_replace(body, '"completion_tokens":[0-9]+', '"completion_tokens":-5')""",
    10: """regexp_replace(body, '"created_at":"[^"]*"', concat('"created_at":', unix_millis(created_at)))""",
    11: """regexp_replace(body, '"created_at":"[^"]*"', concat('"created_at":"', unix_seconds(created_at), '"'))""",
    12: """regexp_replace(body, '"redacted":false', '"redacted":"yes"')""",
    13: """regexp_replace(body, '"redacted":false', '"redacted":2')""",
    14: """regexp_replace(body, '^[{]', '{"colour":{"a":[1]},')""",
    15: "'{bad'",
    16: "'[]'",
    17: "'null'",
    18: """regexp_replace(body, '"(request_id|created_at)":"[^"]*",', '')""",
    19: """regexp_replace(body, '"session_id":"[^"]*"', '"session_id":""')""",
}
DEAD_KINDS = [1, 2, 3, 4, 5, 8, 9, 13, 15, 16, 17]


def wire_events(spark: SparkSession, sf_dir: str, damaged: str = "true") -> DataFrame:
    """The calls as JSON events, some odd but valid, some (where `damaged` holds) bad."""
    plain = ["request_id", "session_id", "provider", "model", "status", "latency_ms", "ttft_ms",
             "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd"]
    fields = ", ".join(f"{CALL[n]} as {n}" for n in plain)
    text_time = f"date_format({CREATED}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") as created_at"
    body = f"to_json(struct({fields}, false as redacted, {text_time}, from_json(props, 'k bigint') as metadata)) as body"
    kinds = " ".join(
        f"when event_id % 40 = {k} and {damaged if k in DEAD_KINDS else 'true'} then {e}" for k, e in DAMAGE.items()
    )
    return (
        over_tasks(table(spark, sf_dir, "events"))
        .selectExpr("event_id", "ts", f"{CREATED} as created_at", body)
        .selectExpr("event_id", "ts", f"case {kinds} else body end as value")
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records of a topic with three partitions."""
    e = F.col("event_id")
    return wire_events(spark, sf_dir).select(
        F.concat(F.lit("k"), e).alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("raw").alias("topic"),
        (e % 3).cast("int").alias("partition"),
        F.floor(e / 3).cast("bigint").alias("offset"),
        to_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client batches of up to 50 events each; some are no batches at all."""
    # One bad event refuses its whole batch: every third batch carries some.
    events = wire_events(spark, sf_dir, damaged="event_id div 50 % 3 = 0").withColumn("batch_id", F.expr("event_id div 50"))
    listed = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    joined = F.array_join(F.transform(listed, lambda x: x["value"]), ",")
    return events.groupBy("batch_id").agg(joined.alias("_all")).select(
        "batch_id",
        F.when(F.col("batch_id") % 20 == 19, F.concat(F.lit('{"rows":['), "_all", F.lit("]}")))
        .otherwise(F.concat(F.lit('{"events":['), "_all", F.lit("]}")))
        .alias("value"),
    )
