"""The ingest stream: sums, restarts, retries; live metrics and assembly."""

import json
import os

import pytest
from pyspark.sql import functions as F

from callsight.operators import calls as call_ops
from callsight.operators.events import parse_events
from callsight.sources import chat, raw
from callsight.sources.logs import read_logs, write_logs
from callsight.streaming import ingest, live
from checks import ingest_queries, inputs


@pytest.fixture(scope="module")
def record_files(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "records")
    inputs.raw_records(spark, sf).repartition(4, "offset").write.json(path)
    return path


def stored(spark, path):
    df = read_logs(spark, path).drop("ingested_at", "batch", "day")
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_equals_batch(spark, record_files, tmp_path):
    paths = [str(tmp_path / n) for n in ("logs", "dead", "checkpoint", "counts")]
    query = ingest.run_ingest(raw.read_raw_stream(spark, record_files, 1), *paths[:3], counts_path=paths[3])
    query.awaitTermination()
    rows, dead = ingest.ingest_rows(raw.read_raw(spark, record_files))
    assert stored(spark, paths[0]) == sorted(map(tuple, rows.collect()), key=repr)
    letters = raw.read_dead_letters(spark, paths[1])
    assert sorted(r.value for r in letters.collect()) == sorted(r.value for r in dead.collect())
    counts = spark.read.parquet(paths[3]).agg(F.count("*"), F.sum("stored"), F.sum("dead")).first()
    want = ingest.ingest_counts(parse_events(raw.read_raw(spark, record_files))).first()
    assert tuple(counts) == (4, want.stored, want.dead)
    assert want.stored + want.dead == raw.read_raw(spark, record_files).count()


def test_restart_after_a_crash_between_the_two_writes(spark, record_files, tmp_path, monkeypatch):
    paths = [str(tmp_path / n) for n in ("logs", "dead", "checkpoint")]
    write, calls = ingest.write_dead_letters, []

    def failing(dead, path, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("lost executor")
        write(dead, path, batch_id)

    monkeypatch.setattr(ingest, "write_dead_letters", failing)
    monkeypatch.setattr(ingest, "write_with_retry", lambda w: w())
    with pytest.raises(Exception):
        ingest.run_ingest(raw.read_raw_stream(spark, record_files, 1), *paths).awaitTermination()
    assert len(calls) == 2
    ingest.run_ingest(raw.read_raw_stream(spark, record_files, 1), *paths).awaitTermination()
    rows, dead = ingest.ingest_rows(raw.read_raw(spark, record_files))
    assert stored(spark, paths[0]) == sorted(map(tuple, rows.collect()), key=repr)
    assert raw.read_dead_letters(spark, paths[1]).count() == dead.count()


def test_replay_with_other_rules_into_a_fresh_table(spark, record_files, tmp_path):
    paths = [str(tmp_path / n) for n in ("logs", "dead", "checkpoint")]
    shout = lambda c: F.struct(F.concat(F.coalesce(c, F.lit("")), F.lit("!")).alias("text"), F.lit(True).alias("changed"))
    ingest.run_ingest(raw.read_raw_stream(spark, record_files, 10), *paths, redactor=shout).awaitTermination()
    found = read_logs(spark, paths[0]).agg(F.min("redacted"), F.min("input_preview"), F.max("input_preview")).first()
    assert tuple(found) == (1, "!", "!")


def test_retry():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise IOError("busy")

    ingest.write_with_retry(flaky, pause=0.001)
    assert len(tries) == 3
    with pytest.raises(IOError):
        ingest.write_with_retry(lambda: (_ for _ in ()).throw(IOError("down")), pause=0.001)


def test_written_records_can_be_read_again(spark, tmp_path):
    events = spark.createDataFrame(
        [("r1", "s", "p", "m", "success"), ("r2", "", "p", "m", "error")],
        "request_id string, session_id string, provider string, model string, status string",
    )
    path = str(tmp_path / "raw")
    for _ in range(2):
        raw.write_raw(events, path, "7")  # the second write replaces the first
    back = raw.read_raw(spark, path).collect()
    assert {(r.key, json.loads(r.value)["request_id"]) for r in back} == {("s", "r1"), ("r2", "r2")}
    assert all(0 <= r.partition < 3 and r.topic == raw.RAW_TOPIC for r in back)
    rows, dead = ingest.ingest_rows(raw.read_raw(spark, path))
    assert {r.request_id for r in rows.collect()} == {"r1", "r2"} and dead.count() == 0


def test_late_rows_are_counted(spark, sf, tmp_path):
    logs = inputs.raw_logs(spark, sf)
    path = str(tmp_path / "rows")
    late = "created_at < '2024-01-02'"
    for i, part in enumerate([f"not ({late})", late, f"not ({late})"]):
        logs.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    counted, metrics = str(tmp_path / "late"), str(tmp_path / "metrics")
    live.keep_input_counts(stream, counted, str(tmp_path / "c1")).awaitTermination()
    live.keep_live_metrics(live.live_metrics(stream, 21600, "1 hour"), metrics, str(tmp_path / "c2")).awaitTermination()
    # The third part repeats the first; only its last buckets are still open.
    ended = logs.where(f"not ({late})").where("created_at < '2024-01-30 18:00:00'").count()
    assert live.late_rows(spark, counted, metrics).first().late == ended


def test_two_streams_share_a_table(spark, record_files, tmp_path):
    """Also when one of them crashed between its two writes and when a checkpoint is made anew."""
    logs, dead = str(tmp_path / "logs"), str(tmp_path / "dead")
    one = raw.read_raw(spark, record_files).count()
    for n in range(3):
        checkpoint = str(tmp_path / ("again" if n else "first"))
        if n == 2:
            os.rename(checkpoint, f"{checkpoint}-old")  # the same path, another stream
        ingest.run_ingest(raw.read_raw_stream(spark, record_files, 2), logs, dead, checkpoint).awaitTermination()
        assert read_logs(spark, logs).count() + raw.read_dead_letters(spark, dead).count() == (n + 1) * one


def test_dead_letters_into_another_sink(spark, record_files, tmp_path):
    got = []
    query = ingest.run_ingest(
        raw.read_raw_stream(spark, record_files), str(tmp_path / "logs"), "", str(tmp_path / "c"),
        dead_sink=lambda dead, name: got.append((name, dead.count())),
    )
    query.awaitTermination()
    _, dead = ingest.ingest_rows(raw.read_raw(spark, record_files))
    assert sum(n for _, n in got) == dead.count() and all(name.endswith("-000000000000") for name, _ in got)


def test_bytes_that_are_no_text_and_records_without_any_time(spark):
    event = b'{"provider":"p\xff","model":"m","status":"success"}'
    rows = [("a", event, None), ("b", event.replace(b"\xff", b""), None), ("c", event.replace(b"\xff", b"\xc3\xa9"), 5.0)]
    df = spark.createDataFrame(rows, "key string, value binary, at double").withColumn("timestamp", F.expr("timestamp_seconds(at)"))
    found = {r.key: (r.reasons, r.event.provider) for r in parse_events(df).collect()}
    assert found["a"][0] == ["json"] and found["b"][0] == ["created_at"] and found["c"] == ([], "pé")


def test_times_without_a_zone_are_utc_in_any_session(spark):
    value = '{"provider":"p","model":"m","status":"success","created_at":"%s"}'
    times = ["2024-01-01T00:00:00", "2024-01-01", "2024-01-01 02:00:00.000+0200", "2023-12-31T19:00:00-05:00", "2024-01-01_00:00Z"]
    df = spark.createDataFrame([(value % t,) for t in times], "value string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        seconds = parse_events(df).select(F.unix_seconds("event.created_at")).collect()
        with pytest.raises(ValueError):
            write_logs(df, "/nowhere", "1")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r[0] for r in seconds} == {1704067200}


def test_assembly_counts_a_chunk_once_and_keeps_order(spark):
    usage = (1, 2, 3)
    rows = [
        ("a", 2, "2024-01-01 00:00:02", "c", None, None), ("a", 0, "2024-01-01 00:00:00", "", None, "m1"),
        ("a", 1, "2024-01-01 00:00:01", "ab", None, ""), ("a", 1, "2024-01-01 00:00:01", "ab", None, ""),
        ("a", 3, "2024-01-01 00:00:03", None, usage, "m2"), ("b", 0, "2024-01-01 00:00:09", "", None, None),
    ]
    kinds = "request_id string, seq bigint, ts string, delta string, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>, model string"
    chunks = spark.createDataFrame(rows, kinds).withColumn("ts", F.col("ts").cast("timestamp"))
    for block in (1, 2, 4096):
        a, b = call_ops.assemble_stream(chunks, block).orderBy("request_id").collect()
        assert (a.text, a.model, tuple(a.usage), str(a.first_token_at)) == ("abc", "m2", usage, "2024-01-01 00:00:01")
        assert (b.text, b.model, b.usage, b.first_token_at) == ("", None, None, None)


def test_sse_lines(spark):
    chunk = lambda text: "data: " + json.dumps({"model": "m", "choices": [{"delta": {"content": text}}]})
    lines = [
        "", ": ping", chunk("Hel"), "data:" + chunk("lo")[5:] + "  ", "data: {broken", 'data: {"choices":[]}',
        'data: {"choices":[],"usage":{}}', 'data: {"usage":{"prompt_tokens":3,"total_tokens":null}}', "event: x",
        "data: [DONE] ", chunk("after"),
    ]
    rows = [("r", i, line) for i, line in enumerate(lines)] + [("open", 0, chunk("no end"))]
    df = spark.createDataFrame(rows, "request_id string, seq bigint, line string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq")))
    found = call_ops.parse_sse_chunks(df).orderBy("request_id", "seq").collect()
    assert [(r.request_id, r.delta, r.usage and tuple(r.usage), r.model) for r in found] == [
        ("open", "no end", None, "m"), ("r", "Hel", None, "m"), ("r", "lo", None, "m"), ("r", "", (3, 0, 0), None),
    ]


def test_chat_snapshot(spark, sf, tmp_path):
    conversations, messages = inputs.conversations(spark, sf), inputs.messages(spark, sf)
    chat.write_chat(conversations, messages, str(tmp_path))
    back = chat.read_chat(spark, str(tmp_path))
    assert back[0].count() == conversations.count() and back[1].count() == messages.count()


def test_large_parts_are_more_files_and_still_a_batch_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_queries, "FILE_ROWS", 1000)
    parts = [spark.range(0, 6000, 1, 3), spark.range(6000, 10000, 1, 3), spark.range(10000, 15000, 1, 3)]
    stream, batches = ingest_queries.stream_of_parts(spark, [p.toDF("id") for p in parts]), []
    query = stream.writeStream.foreachBatch(lambda rows, _: batches.append(
        tuple(rows.withColumn("f", F.input_file_name()).agg(F.count_distinct("f"), F.count("id"), F.min("id")).first())))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert batches == [(4, 6000, 0), (4, 4000, 6000), (4, 5000, 10000)]
