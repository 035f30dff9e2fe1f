"""Live assembly of streamed replies with keyed state.

A request's state is its chunks in blocks of BLOCK numbers and one small row with what they said
last. A block is one entry of a map, so no state row holds more than a block, however long the reply
is, and a chunk that comes twice lands in its block once. A timer closes a request when no chunk came
for the gap; its blocks are then joined in order and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callsight.functions import text

BLOCK = 4096
# Map state and timers need the state store that keeps its rows outside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HEAD = [
    "model", "model_at", "prompt_tokens", "completion_tokens", "total_tokens", "usage_at", "first_at", "last_at",
]
HEAD_DDL = ", ".join(f"{name} {'string' if name == 'model' else 'bigint'}" for name in HEAD)
USAGE = HEAD[2:5]
REPLY_DDL = f"request_id string, reply string, {HEAD_DDL}"


def _later(row: dict, at: str, seqs: list, found: list[int], columns: dict[str, list]) -> None:
    """Takes over the columns of the row with the highest number, if that is above the one known."""
    numbered = [i for i in found if seqs[i] == seqs[i]]
    if numbered:
        last = max(numbered, key=seqs.__getitem__)
        if row[at] is None or int(seqs[last]) >= row[at]:
            row[at] = int(seqs[last])
            for c, values in columns.items():
                row[c] = None if pd.isna(values[last]) else values[last] if c == "model" else int(values[last])


class Replies(StatefulProcessor):
    """The reply of one request; `gap` in milliseconds."""

    def __init__(self, gap: int, block: int):
        self.gap, self.block = gap, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD_DDL)
        self.blocks = handle.getMapState("blocks", "block bigint", "seqs array<bigint>, deltas array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.head.get()  # calls to the state and pandas' own per request cost most here: few of both
        empty = known is None
        head = dict.fromkeys(HEAD) if empty else dict(zip(HEAD, known, strict=True))
        for part in rows:
            seqs, ats, deltas, models = (part[c].tolist() for c in ("seq", "at", "delta", "model"))
            if head["last_at"] is not None and int(min(ats)) > head["last_at"] + 1000 * self.gap:
                yield self._closed(key, tuple(head[name] for name in HEAD))
                head = dict.fromkeys(HEAD)
            blocks: dict[int, dict[int, str]] = {}
            for seq, delta in zip(seqs, deltas, strict=True):
                if seq == seq:  # a missing number is none
                    blocks.setdefault(int(seq // self.block), {})[int(seq)] = delta
            for number in sorted(blocks):
                held = blocks[number]
                if not empty and self.blocks.containsKey((number,)):
                    held = dict(zip(*self.blocks.getValue((number,)), strict=True)) | held
                order = sorted(held)
                self.blocks.updateValue((number,), (order, [held[s] for s in order]))
            empty = False
            _later(head, "model_at", seqs, [i for i, m in enumerate(models) if not pd.isna(m)], {"model": models})
            told = [i for i, has in enumerate(part["has_usage"].tolist()) if has]
            _later(head, "usage_at", seqs, told, {c: part[c].tolist() for c in USAGE} if told else {})
            first = min((int(at) for at, delta in zip(ats, deltas, strict=True) if delta != ""), default=None)
            if first is not None:
                head["first_at"] = min(first, head["first_at"] or first)
            head["last_at"] = max(int(max(ats)), head["last_at"] or 0)
        self.head.update(tuple(head[name] for name in HEAD))
        if known is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(head["last_at"] // 1000 + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._closed(key, self.head.get())

    def _closed(self, key, head: tuple) -> pd.DataFrame:
        """The reply as it is; its state goes."""
        numbers = sorted(k[0] for k in self.blocks.keys())
        reply = "".join("".join(self.blocks.getValue((n,))[1]) for n in numbers)
        self.head.clear()
        self.blocks.clear()
        row = pd.DataFrame([(key[0], reply, *head)], columns=["request_id", "reply", *HEAD])
        return row.astype({c: "Int64" for c in HEAD if c != "model"})

    def close(self) -> None:
        pass


def assemble_stream_live(chunks: DataFrame, gap_seconds: int, delay: str, block: int = BLOCK) -> DataFrame:
    """Replies of a chunk stream: a request is complete once no chunk came for the gap.

    In batches use `assemble_stream`, which gives the same text, model, usage and times;
    `whole_replies` adds those that a stream that has ended did not get to close. Sets the session's
    state store to the one that map state needs; chunks later than `delay` are left out.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    told = chunks.withWatermark("ts", delay).select(
        "request_id",
        "seq",
        "ts",
        F.unix_micros("ts").alias("at"),
        text.blank(F.col("delta")).alias("delta"),
        text.missing_if_blank(F.col("model")).alias("model"),
        F.col("usage").isNotNull().alias("has_usage"),
        *[F.col("usage")[c].alias(c) for c in USAGE],
    )
    closed = told.groupBy("request_id").transformWithStateInPandas(
        Replies(gap_seconds * 1000, block), REPLY_DDL, "Append", "EventTime"
    )
    usage = F.when(F.col("usage_at").isNotNull(), F.struct(*USAGE))
    return closed.select(
        "request_id",
        F.col("reply").alias("text"),
        "model",
        usage.alias("usage"),
        F.timestamp_micros("first_at").alias("first_token_at"),
        F.timestamp_micros("last_at").alias("last_chunk_at"),
    )
