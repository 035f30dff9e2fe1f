"""What the physical plans of the registered queries must and must not contain."""

import pytest

from callsight.operators import calls, conversations
from checks import registry

# Queries that write and read files or run a stream while they are built.
RUNNING = ("stream_", "compacted_", "pruned_", "latest_", "expired_", "chat_", "raw_round", "summary_unreachable")


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if not n.startswith(RUNNING)])
def test_no_all_pairs_and_no_row_functions(spark, sf, name):
    text = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name == "redact_custom_engine")


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.fixture
def small_skew_limits(spark):
    """Settings under which a few hundred kilobytes count as a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.count()
    df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


HOT = "if(id % 3 = 0, 'hot', concat('r', id))"


def test_a_hot_request_is_split(spark, small_skew_limits):
    messages = spark.range(0, 120000, 1, 8).selectExpr(
        "cast(id as string) as id", f"{HOT} as request_id", "sha2(cast(id as string), 512) as content"
    )
    logs = spark.range(0, 120000, 1, 8).selectExpr(
        f"{HOT} as request_id", "timestamp_seconds(id) as created_at", "timestamp_seconds(id) as ingested_at",
        "'p' as provider", "'m' as model", "'success' as status", "1D as latency_ms", "1D as ttft_ms",
    )
    rows, plan = final_plan(conversations.trace_messages(messages, logs))
    assert rows == 120000 and "SortMergeJoin(skew=true)" in plan


def test_a_conversation_with_most_messages_is_split(spark, small_skew_limits):
    messages = spark.range(0, 120000, 1, 8).selectExpr(
        "cast(id as string) as id", f"{HOT} as conversation_id", "sha2(cast(id as string), 512) as content",
        "timestamp_seconds(id) as created_at",
    )
    conv = spark.range(0, 50000, 1, 8).selectExpr(
        "if(id = 0, 'hot', concat('r', id)) as id", "'t' as title", "'active' as status", "'m' as model",
        "timestamp_seconds(id) as created_at", "timestamp_seconds(id) as updated_at",
    )
    plan = final_plan(conversations.conversation_detail(conv, messages))[1]
    assert "SortMergeJoin(skew=true)" in plan


def test_a_request_with_most_lines_is_split(spark, small_skew_limits):
    lines = spark.range(0, 120000, 1, 8).selectExpr(
        f"{HOT} as request_id", "id as seq", "timestamp_seconds(id) as ts",
        """concat('data: {"choices":[{"delta":{"content":"', sha2(cast(id as string), 512), '"}}]}') as line""",
    )
    marks = spark.range(0, 120000, 1, 8).selectExpr(
        f"{HOT} as request_id", "200000 + id as seq", "timestamp_seconds(id) as ts", "'data: [DONE]' as line"
    )
    rows, plan = final_plan(calls.parse_sse_chunks(lines.union(marks)))
    assert rows == 120000 and "SortMergeJoin(skew=true)" in plan


def test_turns_to_one_conversation_are_split(spark, small_skew_limits):
    turns = spark.range(0, 120000, 1, 8).selectExpr(
        "cast(id as string) as turn_id", f"{HOT} as conversation_id", "sha2(cast(id as string), 512) as message"
    )
    conv = spark.range(0, 50000, 1, 8).selectExpr("if(id = 0, 'hot', concat('r', id)) as id", "'active' as status")
    rows, plan = final_plan(conversations.gate_turns(turns, conv))
    assert rows == 120000 and "SortMergeJoin(skew=true)" in plan
