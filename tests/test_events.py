"""Validation of events, defaults, log rows and client batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from callsight.operators import events as ops

BASE = {"provider": "p", "model": "m", "status": "success"}
RAW = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"


def judge(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    return [r for r in ops.parse_events(rows).orderBy("i").collect()]


def raw_field(name, text):
    return json.dumps(BASE)[:-1] + f', "{name}": {text}}}'


FIELD_CASES = [
    ("prompt_tokens", "1", 1), ("prompt_tokens", '"12"', 12), ("prompt_tokens", "12.0", 12), ("prompt_tokens", "12.5", None),
    ("prompt_tokens", "true", 1), ("prompt_tokens", '" 7 "', 7), ("prompt_tokens", '"12.0"', 12), ("prompt_tokens", '"1_0"', 10),
    ("prompt_tokens", "1e2", 100), ("prompt_tokens", "null", None), ("prompt_tokens", "[]", None), ("prompt_tokens", '"1."', None),
    ("prompt_tokens", "4294967295", 4294967295), ("prompt_tokens", "4294967296", None), ("prompt_tokens", "-5", None),
    ("latency_ms", "1", 1.0), ("latency_ms", '" 7.5 "', 7.5), ("latency_ms", '"1e3"', 1000.0), ("latency_ms", '"nan"', None),
    ("latency_ms", "null", None), ("latency_ms", "1e400", None), ("latency_ms", '"12d"', None), ("latency_ms", "NaN", None),
    ("redacted", "1", True), ("redacted", "0.0", False), ("redacted", "2", None), ("redacted", '"yes"', True),
    ("redacted", '"OFF"', False), ("redacted", '"maybe"', None), ("redacted", "null", None),
    ("metadata", '{"a":[1,null]}', '{"a":[1,null]}'), ("metadata", "null", None), ("metadata", "[1]", None),
    ("metadata", '"{}"', None), ("metadata", '{"a":1,"a":2}', None),
    ("request_id", "7", None), ("request_id", '"r"', "r"), ("request_id", "null", None),
]


def test_fields(spark):
    found = judge(spark, [raw_field(name, text) for name, text, _ in FIELD_CASES])
    for (name, text, want), row in zip(FIELD_CASES, found):
        if want is None:
            assert row.reasons == [name], (name, text, row.reasons)
        else:
            assert row.reasons == [] and row.event[name] == want, (name, text, row)


TIMES = {
    '"2024-01-01T00:00:07.123Z"': "2024-01-01 00:00:07.123", '"2024-01-01 00:00:07"': "2024-01-01 00:00:07",
    '"2024-01-01"': "2024-01-01 00:00:00", '"2024-01-01T00:00:07+02:00"': "2023-12-31 22:00:07",
    '"2024-01-01T00:00:07+0200"': "2023-12-31 22:00:07", "1704067207": "2024-01-01 00:00:07",
    "1704067207123": "2024-01-01 00:00:07.123", '"1704067207"': "2024-01-01 00:00:07",
    "1704067207.5": "2024-01-01 00:00:07.5", '"2024-01-01_00:00:07"': "2024-01-01 00:00:07", "-5": "1969-12-31 23:59:55",
    '"2024-01"': None, '"now"': None, "true": None, '"2024-13-01"': None, '"2024-02-30"': None, "null": None,
}


def test_times(spark):
    rows = [(i, raw_field("created_at", t)) for i, t in enumerate(TIMES)]
    parsed = ops.parse_events(spark.createDataFrame(rows, "i int, value string"))
    found = parsed.select("i", F.col("event.created_at").cast("string").alias("t"), "reasons").orderBy("i").collect()
    for (text, want), row in zip(TIMES.items(), found):
        assert row.t == want and row.reasons == ([] if want else ["created_at"]), (text, row)


@pytest.mark.parametrize(
    "value,reasons",
    [
        (json.dumps(BASE), []),
        (json.dumps(BASE | {"colour": {"a": [1]}}), []),
        (json.dumps(BASE | {"session_id": None, "ttft_ms": None, "cost_usd": None, "error_type": None}), []),
        ('{"provider":"p","provider":"q","model":"m","status":"error"}', []),
        ("  " + json.dumps(BASE) + "\n", []),
        ('{"provider":"p","status":"error"}', ["model"]),
        ('{"provider":5,"model":"m","status":"weird"}', ["provider", "status"]),
        ("{bad", ["json"]), ("[]", ["json"]), ("null", ["json"]), ("5", ["json"]), ("", ["json"]), (None, ["json"]),
        (json.dumps([BASE]), ["json"]), (json.dumps(BASE) + "]", ["json"]), (json.dumps(BASE) + "}", ["json"]),
        (json.dumps(BASE) + " x", ["json"]), (json.dumps(BASE) + "," + json.dumps(BASE), ["json"]),
        (json.dumps(BASE) + "],[" + json.dumps(BASE), ["json"]), (json.dumps(BASE).replace('"', "'"), ["json"]),
    ],
)
def test_records(spark, value, reasons):
    assert judge(spark, [value])[0].reasons == reasons


def test_repeated_key_last_wins(spark):
    row = judge(spark, ['{"provider":"p","provider":"q","model":"m","status":"error"}'])[0]
    assert row.event.provider == "q"


def test_split_keeps_every_record(spark):
    values = [json.dumps(BASE), "{bad", raw_field("latency_ms", "null"), json.dumps(BASE)]
    rows = spark.createDataFrame([("k", v, "t", 0, i, dt.datetime(2024, 1, 1)) for i, v in enumerate(values)], RAW)
    valid, dead = ops.split_valid(ops.parse_events(rows))
    assert valid.count() == 2
    assert [(r.key, r.value, r.offset) for r in dead.orderBy("offset").collect()] == [("k", values[1], 1), ("k", values[2], 2)]


def test_defaults_are_repeatable(spark):
    rows = spark.sql(
        f"""select 'k' as key, '{json.dumps(BASE)}' as value, 't' as topic, 1 as partition, off as offset,
        timestamp'2024-01-02 03:04:05.678901' as timestamp from values (5L), (6L), (cast(null as bigint)) as v(off)"""
    )
    read = lambda: ops.to_log_row(ops.apply_defaults(ops.split_valid(ops.parse_events(rows))[0])).collect()
    first, again = read(), read()
    assert first == again and len({r.request_id for r in first}) == 3
    row = first[0].asDict()
    assert len(row["request_id"]) == 36 and str(row["created_at"]) == "2024-01-02 03:04:05.678000"
    assert [row[c] for c in ("session_id", "conversation_id", "error_type", "error_message", "input_preview")] == [""] * 5
    assert (row["latency_ms"], row["ttft_ms"], row["cost_usd"], row["total_tokens"]) == (0.0, None, None, 0)
    assert (row["redacted"], row["metadata"]) == (0, "{}")
    assert list(row) == ops.EVENT_COLUMNS


def test_batches_pass_whole_or_not(spark):
    good, bad = json.dumps(BASE | {"request_id": "a"}), json.dumps({"provider": "p"})
    values = {
        "all good": f'{{"events":[{good},{good}]}}', "one bad": f'{{"events":[{good},{bad}]}}', "empty": '{"events":[]}',
        "no list": '{"events":5}', "other": '{"rows":[]}', "broken": f'{{"events":[{good}', "text": json.dumps({"events": [good]}),
        "null": '{"events":[null]}', "number": '{"events":[1]}',
    }
    rows = spark.createDataFrame(list(values.items()), "name string, value string")
    judged = {r.name: (r.accepted, r.n_events) for r in ops.judge_batches(rows).collect()}
    assert {n for n, (ok, _) in judged.items() if ok} == {"all good", "empty"}
    assert judged["all good"][1] == 2 and judged["broken"][1] == 0
    out = ops.explode_batches(rows).orderBy("position").collect()
    assert [(r.name, r.position, json.loads(r.value)["request_id"]) for r in out] == [("all good", 0, "a"), ("all good", 1, "a")]


def test_generated_code_is_short_enough_for_the_jit(spark):
    rows = spark.createDataFrame([("k", json.dumps(BASE), "t", 0, 1, dt.datetime(2024, 1, 1))], RAW)
    valid = ops.to_log_row(ops.apply_defaults(ops.split_valid(ops.parse_events(rows))[0]))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(valid._jdf.queryExecution().executedPlan())
    assert max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())) <= 8000


def test_record_is_parsed_once(spark):
    """However many filters and columns ask for it."""
    rows = spark.createDataFrame([("k", json.dumps(BASE), "t", 0, 1, dt.datetime(2024, 1, 1))], RAW)
    valid = ops.to_log_row(ops.apply_defaults(ops.split_valid(ops.parse_events(rows))[0]))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # texts and kinds
