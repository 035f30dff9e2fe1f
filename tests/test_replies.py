"""Live assembly: long replies, copies, disorder, several batches, and what stays open."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from callsight.operators.calls import assemble_stream
from callsight.schemas import CHUNK_SCHEMA
from callsight.streaming import live, replies


def run(spark, path, out, gap=60, block=64, per_batch=1):
    stream = spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)
    found = replies.assemble_stream_live(stream, gap, "1 second", block)
    query = found.writeStream.format("parquet").option("path", f"{out}/replies").option("checkpointLocation", f"{out}/c")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/replies")


def chunk_rows(spark, rows):
    """rows: (request, seq, second, delta, completion tokens or None, model)."""
    df = spark.createDataFrame(rows, "request_id string, seq bigint, at double, delta string, n bigint, model string")
    usage = F.when(F.col("n").isNotNull(), F.struct(F.lit(3).cast("bigint").alias("prompt_tokens"), F.col("n").alias("completion_tokens"), (F.col("n") + 3).alias("total_tokens")))
    return df.select("request_id", "seq", F.timestamp_micros(((F.col("at") + 1e6) * 1e6).cast("bigint")).alias("ts"), "delta", usage.alias("usage"), "model")


def test_equals_the_batch_form(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for r in range(30):
        start, n = 100 * r, rnd.choice([1, 5, 63, 64, 65, 300])
        for s in range(n):
            rows.append((f"r{r}", s, start + s * 0.01, rnd.choice(["", "a", f"w{s} ", None]), None, rnd.choice([None, "", f"m{s}"])))
        rows.append((f"r{r}", n, start + n * 0.01, None, n, None))
    rows += [rnd.choice(rows) for _ in range(200)]
    chunks = chunk_rows(spark, rows)
    path = f"{tmp_path}/chunks"
    for low in range(0, 3000, 500):  # in the order of time, shuffled inside a batch, one file a batch
        chunks.where((F.unix_seconds("ts") >= 10**6 + low) & (F.unix_seconds("ts") < 10**6 + low + 500)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(path)
    closed = run(spark, path, str(tmp_path))
    whole = live.whole_replies(closed, spark.read.schema(CHUNK_SCHEMA).parquet(path))
    key = lambda df: sorted(map(tuple, df.select("request_id", "text", "model", "usage", "first_token_at", "last_chunk_at").collect()))
    assert 20 < closed.count() < 30
    assert key(whole) == key(assemble_stream(chunks))


def test_a_very_long_reply_is_held_in_blocks(spark, tmp_path):
    n = 60_000
    path = f"{tmp_path}/chunks"
    rows = spark.range(0, n, 1, 4).selectExpr(
        "'long' as request_id", "id as seq", "timestamp_millis(id + 1000) as ts", "concat(id, ' ') as delta",
        "cast(null as struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>) as usage", "'m' as model",
    )
    rows.where("id < 40000").coalesce(1).write.parquet(path)
    rows.where("id >= 40000").coalesce(1).write.mode("append").parquet(path)
    end = rows.where("id = 0").withColumns({"request_id": F.lit("end"), "ts": F.timestamp_seconds(F.lit(100_000))})
    end.coalesce(1).write.mode("append").parquet(path)
    closed = run(spark, path, str(tmp_path), block=replies.BLOCK).collect()
    assert [r.request_id for r in closed] == ["long"]
    assert closed[0].text == "".join(f"{i} " for i in range(n)) and closed[0].model == "m" and closed[0].usage is None


class Held(dict):
    """A map state in memory that remembers its largest entry."""

    most = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        Held.most = max(Held.most, len(value[0]))


def test_no_state_row_is_larger_than_a_block():
    class Head:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        timers = []

        def listTimers(self):
            return iter([(t,) for t in self.timers])

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    made = replies.Replies(1000, 128)
    made.handle, made.head, made.blocks = Handle(), Head(), Held()
    for low in range(0, 100_000, 10_000):
        part = pd.DataFrame({"seq": range(low, low + 10_000), "at": range(low, low + 10_000), "delta": "x", "model": None, "has_usage": False})
        list(made.handleInputRows(("r",), iter([part]), None))
    assert Held.most == 128 and len(made.blocks) == -(-100_000 // 128)
    assert Handle.timers == [99_999 // 1000 + 1000] and made.head.value[-1] == 99_999


@pytest.mark.parametrize("block", [1, 4096])
def test_a_reply_that_goes_on_after_its_end_is_two(spark, tmp_path, block):
    rows = [[("a", 0, 0.0, "x", None, "m")], [("b", 0, 500.0, "y", None, "m")], [("a", 1, 1000.0, "z", None, None)], [("c", 0, 2000.0, "", None, None)]]
    for part in rows:
        chunk_rows(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    got = sorted((r.request_id, r.text) for r in run(spark, f"{tmp_path}/chunks", str(tmp_path), block=block).collect())
    assert got == [("a", "x"), ("a", "z"), ("b", "y")]


def test_a_new_request_asks_the_state_for_little(monkeypatch):
    """Every call to the state goes to the JVM and back."""
    asked = []

    class State:
        def __getattr__(self, name):
            return lambda *args: asked.append(name)

    made = replies.Replies(1000, 128)
    made.handle, made.head, made.blocks = State(), State(), State()
    part = pd.DataFrame({"seq": [1, 0], "at": [20, 10], "delta": ["b", "a"], "model": [None, "m"], "has_usage": False})
    assert list(made.handleInputRows(("r",), iter([part]), None)) == []
    assert asked == ["get", "updateValue", "update", "registerTimer"]
