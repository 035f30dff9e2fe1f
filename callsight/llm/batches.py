"""Documents as batches of numbered words, and counts of keys over all batches.

`word_batches` turns documents into rows of about BATCH_WORDS words, each with the batch's
distinct words (64-bit hashes) and every document's words as places in them. `total_counts`
answers, for every distinct key of every batch, how often the whole corpus has it: a batch
sorts its keys, cuts them into buckets by their highest bits, and sends each part with its
own counts; a bucket adds up and sends each batch its totals back, in the order in which the
batch asked. A key is sent once per batch, however often the batch holds it, so frequent keys
are combined before the shuffle, and a task holds one bucket of about BUCKET_KEYS keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import WordCache, kept, release, releasing, text_bytes, worker_state

BATCH_WORDS = 500_000
BUCKET_KEYS = 2_000_000

U64 = np.uint64
BATCH = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("marks", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("words", pa.binary()),
        ("at", pa.binary()),
        ("n_tokens", pa.int64()),
    ]
)
BATCH_DDL = "part int, doc_ids array<long>, marks array<long>, sizes array<int>, words binary, at binary, n_tokens long"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones apart."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class _Open:
    """A batch that is being filled."""

    def __init__(self, part: int):
        self.part, self.ids, self.marks, self.hashes, self.size = part, [], [], [], 0

    def row(self) -> dict:
        sizes = [len(h) for h in self.hashes]
        words, at, times = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words))
        return {
            "part": self.part,
            "doc_ids": self.ids,
            "marks": self.marks,
            "sizes": sizes,
            "words": words[order].astype("<u8").tobytes(),
            "at": _planes(number[at]),
            "n_tokens": sum(sizes),
        }


def text_mark(name: str = "text") -> Column:
    return F.xxhash64(F.col(name).cast("string"))


def word_batches(docs: DataFrame, part_of: Callable[[int | None], int] | None = None) -> DataFrame:
    """The batches of `docs` (doc_id, text), numbered by `batch` (a kept table).

    Words are runs of characters other than ASCII white space, A-Z made small. With
    `part_of`, the documents of each part come in batches of their own. A document's mark,
    `text_mark` of its text, tells rows that repeat an id apart.
    """

    def fill(batches):
        cache = worker_state("word hashes", lambda: WordCache(word_hash))
        filling = {}
        for batch in batches:
            for doc_id, text, mark in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.lower().split()
                part = part_of(doc_id) if part_of else 0
                now = filling.setdefault(part, _Open(part))
                now.ids.append(doc_id)
                now.marks.append(mark)
                now.hashes.append(np.fromiter(map(cache.fresh().__getitem__, words), np.uint64, len(words)))
                now.size += len(words) + 1
                if now.size >= BATCH_WORDS:
                    yield pa.RecordBatch.from_pylist([filling.pop(part).row()], schema=BATCH)
        for rest in filling.values():
            yield pa.RecordBatch.from_pylist([rest.row()], schema=BATCH)

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), text_mark().alias("mark"))
    rows = told.mapInArrow(releasing(fill), BATCH_DDL)
    return kept(rows.withColumn("batch", F.monotonically_increasing_id()), "batches")


def hashes_of(row: dict) -> np.ndarray:
    """Word hashes of all documents of a batch, one after the other."""
    return np.frombuffer(row["words"], "<u8")[_unplanes(row["at"])]


def rows_of(batch: pa.RecordBatch):
    """A batch's rows as dicts, one at a time, binary columns without a copy."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        yield {
            name: (c[i].as_buffer() if pa.types.is_binary(c.type) and c[i].is_valid else c[i].as_py())
            for name, c in columns.items()
        }


def total_counts(
    batches: DataFrame,
    ask: Callable[[dict], tuple[np.ndarray, np.ndarray]],
    n_keys: int,
    classes: int = 1,
    bits: int = 64,
) -> DataFrame:
    """batch, answers (bucket, totals, see `_narrow`) of every batch (a kept table).

    `ask` gives a batch's distinct keys below 2^`bits` in rising order and their counts. `n_keys` is about
    how many keys all batches ask for. Totals are exact up to 2^53. The row with batch -1
    holds, per bucket, how many keys have a total over 0, by key modulo `classes`.
    """
    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    edges = [(k << bits) // buckets for k in range(1, buckets)]

    def send(rows):
        for batch in rows:
            for row in rows_of(batch):
                keys, counts = ask(row)
                cuts = [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _, _ in some], pa.int32()),
                            pa.array([row["batch"]] * len(some), pa.int64()),
                            pa.array([_packed(keys[a:b]) for _, a, b in some], pa.binary()),
                            pa.array([_narrow(counts[a:b]) for _, a, b in some], pa.binary()),
                        ],
                        names=["bucket", "batch", "keys", "counts"],
                    )

    def add_up(part: pa.Table) -> pa.Table:
        keys = [_unpacked(b.as_buffer()) for b in part["keys"]]
        counts = np.concatenate([_wide(b.as_py()) for b in part["counts"]])
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        totals = np.bincount(place, counts, len(distinct)).astype(np.int64)
        answer = totals[place]
        filled = np.bincount((distinct[totals > 0] % U64(classes)).astype(np.int64), minlength=classes)
        cuts = np.cumsum([0, *sizes])
        bucket = part["bucket"][0].as_py()
        return pa.table(
            {
                "batch": pa.array([*part["batch"].to_pylist(), -1], pa.int64()),
                "bucket": pa.array([bucket] * (len(sizes) + 1), pa.int32()),
                "totals": pa.array(
                    [*(_narrow(answer[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), _narrow(filled)], pa.binary()
                ),
            }
        )

    def bucket_totals(part: pa.Table) -> pa.Table:
        answers = add_up(part)
        release()
        return answers

    sent = batches.mapInArrow(releasing(send), "bucket int, batch long, keys binary, counts binary")
    return kept(sent.groupBy("bucket").applyInArrow(bucket_totals, "batch long, bucket int, totals binary"), "totals")


def filled_keys(totals: DataFrame, classes: int) -> list[int]:
    """How many distinct keys have a total over 0, by key modulo `classes`."""

    def add(batches):
        found = np.zeros(classes, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                found += _wide(row).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array(found)], names=["k", "n"])

    rows = totals.where("batch = -1").select("totals").mapInArrow(add, "k int, n long")
    return [r.n for r in rows.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()] or [0] * classes


def with_totals(batches: DataFrame, totals: DataFrame) -> DataFrame:
    """Every batch with its answers, in the order of buckets."""
    answers = totals.where("batch >= 0").groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "totals"))).alias("answers")
    )
    return batches.join(answers, "batch", "left")


def totals_of(row: dict) -> np.ndarray:
    """The totals of a batch's keys, in the order in which it asked."""
    return np.concatenate([np.zeros(0, np.int64), *(_wide(a["totals"]).astype(np.int64) for a in row["answers"] or ())])


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs; the first byte says how many."""
    most = int(numbers.max()) if len(numbers) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: all lowest bytes, then all second ones, and so on, as far
    as they are not all 0. Small numbers leave long runs that compress well."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]).tobytes()


def _unplanes(data) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    planes = data[1:].reshape(data[0], -1)
    numbers = np.zeros((planes.shape[1], 4), np.uint8)
    numbers[:, : data[0]] = planes.T
    return numbers.view("<u4").ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Rising keys: the first one in eight bytes, then the steps in as many as the largest needs."""
    steps = np.diff(keys).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    narrow = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + narrow.tobytes()


def _unpacked(data) -> np.ndarray:
    data = memoryview(data)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data[9:], np.uint8).reshape(-1, width)
    first = np.frombuffer(data[1:9], "<u8")
    return np.concatenate([first, first + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)])
