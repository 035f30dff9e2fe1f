"""Conversation jobs on small tables, empty tables and skewed ones."""

import pytest
from pyspark.sql import functions as F

from callsight.operators import conversations as ops
from checks import inputs


@pytest.fixture(scope="module")
def tables(spark, sf):
    return inputs.conversations(spark, sf).cache(), inputs.messages(spark, sf).cache()


def test_arguments(tables):
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"status": "open"}):
        with pytest.raises(ValueError):
            ops.list_conversations(*tables, **bad)


def test_list_is_ordered_and_paged(tables):
    whole = ops.list_conversations(*tables, limit=200).collect()
    assert whole == sorted(whole, key=lambda r: (-r.updated_at.timestamp(), r.id))
    assert ops.list_conversations(*tables, limit=5, offset=3).collect() == whole[3:8]
    assert {r.message_count for r in whole if r.id.startswith("empty")} == {0}


def test_unknown_conversation(tables):
    assert ops.by_key(tables[0], "nobody").collect() == []


def test_no_messages(spark, tables):
    conversations, none = tables[0], tables[1].where("1 = 0")
    assert {r.message_count for r in ops.with_message_count(conversations, none).collect()} == {0}
    detail = ops.conversation_detail(conversations, none).collect()
    assert len(detail) == conversations.count() and all(r.message_id is None for r in detail)
    for op in (ops.context, ops.last_user_text):
        assert op(none).collect() == []


def test_cancelling_twice_is_a_no_op(spark, sf, tables):
    cancels = inputs.cancels(spark, sf)
    once = ops.apply_cancels(tables[0], cancels, "2024-02-01").cache()
    again = ops.apply_cancels(once, cancels, "2024-03-01")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_a_new_conversation_is_made_once(spark):
    turns = spark.createDataFrame(
        [("t1", None, " Hi\nthere ", ""), ("t2", "gone", "x", None), ("t3", "c", "", None), ("t4", "c", "y", None), ("t5", "old", "z", None)],
        "turn_id string, conversation_id string, message string, model string",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    known = spark.createDataFrame([("c", "active"), ("old", "archived")], "id string, status string")
    gated = ops.gate_turns(turns, known)
    verdicts = {r.turn_id: r.verdict for r in gated.collect()}
    assert verdicts == {"t1": "new", "t2": "not_found", "t3": "empty", "t4": "ok", "t5": "closed"}
    first, again = (ops.new_conversations(gated).collect() for _ in range(2))
    assert first == again and [(r.title, r.model) for r in first] == [("Hi there", ops.DEFAULT_MODEL)]


def test_one_conversation_with_most_messages(spark):
    messages = spark.range(20000).selectExpr(
        "concat('m', lpad(id, 6, '0')) as id", "if(id % 3 = 0, concat('c', id), 'hot') as conversation_id",
        "if(id % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as content", "timestamp_seconds(id) as created_at",
    )
    hot = ops.context(messages, 5).where("conversation_id = 'hot'").first().messages
    assert [m.content for m in hot] == ["19993", "19994", "19996", "19997", "19999"]
    assert ops.last_user_text(messages).where("conversation_id = 'hot'").first().last_user_text == "19996"
    text = ops.context(messages, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_trace_keeps_every_message(spark, sf, tables):
    traced = ops.trace_messages(tables[1], inputs.raw_logs(spark, sf))
    assert traced.count() == tables[1].count()
    lost = ops.messages_without_log(tables[1], inputs.raw_logs(spark, sf)).count()
    assert traced.where("request_id is not null and not has_log").count() == lost


def test_a_long_conversation_nests_in_order_and_by_blocks(spark):
    n = 20_000
    messages = spark.range(0, n, 1, 6).selectExpr(
        "concat('m', lpad(id, 6, '0')) as id", "if(id % 3 = 0, concat('c', id % 5), 'hot') as conversation_id", "'user' as role",
        "'x' as content", "'complete' as status", "cast(null as bigint) as prompt_tokens", "cast(null as bigint) as completion_tokens",
        "cast(null as string) as request_id", "timestamp_seconds(pmod(xxhash64(id), 50000)) as created_at",
    )
    conversations = spark.sql("select concat('c', id) as id, 't' as title from range(7) union all select 'hot', 't'")
    found = ops.conversation_nested(conversations, messages, 1000)
    got = {r.id: [(m.created_at, m.id) for m in r.messages] for r in found.collect()}
    want = {}
    for r in messages.collect():
        want.setdefault(r.conversation_id, []).append((r.created_at, r.id))
    assert got == {c: sorted(want.get(c, [])) for c in got} and len(got) == 8 and got["c6"] == []
    assert len(got["hot"]) > n / 2
