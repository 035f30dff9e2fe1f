"""Shards by fixed virtual slots.

Every record is hashed into one of SLOTS virtual slots, a number that never changes. A map says
which shard has which slot, and is stored in versions: version 0 deals the slots out by their
number, a later version holds only the entries that an edit has changed. `rebalanced` edits a map
by the bytes that lie in each slot, moving or exchanging slots between the fullest and the emptiest
shards until no such edit helps; `grown` adds a shard, which takes slots from the others. So the law
is one of bytes: shards hold nearly equal numbers of them, whatever the number of records.

The bytes are summed per slot before the shuffle, so the driver sees at most SLOTS sums, however
large the table. A slot that alone holds a good part of a shard is hot, for example one with many
copies of a record: it is entered several times, and its records, which no hash can tell apart, are
dealt over the entries by their place in the input. A record is never cut, so shards are equal up to
about the size of the largest one.

Records are written into the folder of their shard in files of about FILE_BYTES. Offsets of the files
within their shard come from row counts; a record's number in its shard is its file's offset and its
place in the file, so no shard is sorted or collected. The input should be a table that is read from
files: there a record has the same place whenever it is read again.

Defined cases: null columns are left out of the hash, a null text has no bytes; rows that repeat all
stay; the record is kept whole in one column, so no names can clash; an empty table gives empty shards.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 16_384
RECORD_BYTES = 8  # what a record weighs beside its text
HOT_PART = 64  # a slot with more than this part of a shard's share is entered several times
MAX_EDITS = 200_000
FILE_BYTES = 128 << 20


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def slot_of(record: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(record), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """entries[slot] holds the slot's shards, more than one where it is hot; edited: slots that this version changed."""

    shards: int
    version: int
    entries: tuple[tuple[int, ...], ...]
    edited: frozenset[int]

    def rows(self) -> list[tuple[int, int, list[int]]]:
        return [(self.version, slot, list(self.entries[slot])) for slot in sorted(self.edited)]

    def _next(self, entries: list[tuple[int, ...]], shards: int) -> SlotMap:
        changed = frozenset(s for s, (a, b) in enumerate(zip(self.entries, entries, strict=True)) if a != b)
        return replace(self, shards=shards, version=self.version + 1, entries=tuple(entries), edited=changed)


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0, which knows nothing of the records."""
    return SlotMap(shards, 0, tuple((s % shards,) for s in range(slots)), frozenset(range(slots)))


def slot_sizes(docs: DataFrame, size: Column, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every slot, and of its largest record. The driver gets a row per slot that has records."""
    record = F.struct(*docs.columns)
    rows = docs.select(slot_of(record, slots).alias("slot"), size.alias("size")).groupBy("slot").agg(
        F.sum("size").alias("total"), F.max("size").alias("largest")
    )
    total, largest = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for row in rows.collect():
        total[row.slot], largest[row.slot] = row.total, row.largest
    return total, largest


def _parts(now: int, total: int, largest: int, share: float) -> int:
    """How many entries a slot needs: parts of a HOT_PART of a share, none smaller than the largest record."""
    return max(now, min(int(total * HOT_PART / max(share, 1)), int(total // max(largest, 1))), 1)


def rebalanced(slot_map: SlotMap, total: np.ndarray, largest: np.ndarray) -> SlotMap:
    """The next version of a map: hot slots have more entries, and entries moved from fuller to emptier shards."""
    shards, share = slot_map.shards, total.sum() / slot_map.shards
    entries = [
        (*e, *((slot + k) % shards for k in range(len(e), _parts(len(e), int(total[slot]), int(largest[slot]), share))))
        for slot, e in enumerate(slot_map.entries)
    ]
    entries = [list(e) for e in entries]
    held = [[] for _ in range(shards)]  # (bytes, slot, number of the entry), rising
    for slot, of in enumerate(entries):
        for k, shard in enumerate(of):
            held[shard].append((float(total[slot]) / len(of), slot, k))
    load = np.array([sum(w for w, _, _ in h) for h in held])
    for h in held:
        h.sort()
    for _ in range(MAX_EDITS):
        edit = _best_edit(held, load)
        if edit is None:
            break
        full, empty, given, taken = edit
        _move(held, load, entries, full, empty, given)
        if taken is not None:
            _move(held, load, entries, empty, full, taken)
    return slot_map._next([tuple(e) for e in entries], shards)


def _best_edit(held: list[list[tuple]], load: np.ndarray):
    """(full, empty, entry given, entry taken or None) that brings two shards closest, fullest shards first."""
    order = np.argsort(-load, kind="stable").tolist()
    for full in order:
        for empty in reversed(order):
            gap = load[full] - load[empty]
            if gap < 1:
                break
            given = np.array([w for w, _, _ in held[full]])
            taken = np.array([0.0, *(w for w, _, _ in held[empty])])
            at = np.clip(np.searchsorted(taken, given - gap / 2), 0, len(taken) - 1)
            left = np.abs(gap - 2 * (given[:, None] - taken[np.stack([at, np.maximum(at - 1, 0)], 1)]))
            best = int(left.argmin()) if left.size else 0
            if left.size and left.flat[best] < gap * 0.99:
                give, side = divmod(best, 2)
                take = int(max(at[give] - side, 0))
                return full, empty, held[full][give], held[empty][take - 1] if take else None
    return None


def _move(held, load, entries, a: int, b: int, entry: tuple) -> None:
    weight, slot, k = entry
    held[a].remove(entry)
    held[b].append(entry)
    held[b].sort()
    load[a] -= weight
    load[b] += weight
    entries[slot][k] = b


def grown(slot_map: SlotMap, total: np.ndarray) -> SlotMap:
    """The next version with one more shard, which takes entries of the fullest shards until it has its share."""
    new, share = slot_map.shards, total.sum() / (slot_map.shards + 1)
    entries = [list(e) for e in slot_map.entries]
    held = [[] for _ in range(new)]
    for slot, of in enumerate(entries):
        for k, shard in enumerate(of):
            held[shard].append((float(total[slot]) / len(of), slot, k))
    load, got = np.array([sum(w for w, _, _ in h) for h in held]), 0.0
    for h in held:
        h.sort()
    while got < share:
        full = int(load.argmax())
        fits = [e for e in held[full] if 0 < e[0] <= share - got]
        if not fits:
            break
        weight, slot, k = entry = max(fits)
        held[full].remove(entry)
        load[full] -= weight
        got += weight
        entries[slot][k] = new
    return slot_map._next([tuple(e) for e in entries], new + 1)


MAP_DDL = "version int, slot int, shards array<int>"


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds a version, the edited entries alone, to the table below `path`; a version that exists is refused."""
    rows = spark.createDataFrame(slot_map.rows(), MAP_DDL)
    rows.drop("version").coalesce(1).write.parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot, shards as of a version: of every slot its latest entry. At most SLOTS rows a version."""
    rows = spark.read.schema(MAP_DDL).parquet(path)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    return rows.groupBy("slot").agg(F.max_by("shards", "version").alias("shards"))


def write(docs: DataFrame, slot_map: DataFrame, path: str, shards: int, total_bytes: int, size: Column, slots: int = SLOTS) -> None:
    """Records into `path`/shard=N/ as files of about FILE_BYTES. `slot_map` has `slots` rows at most."""
    files, record = max(1, -(-total_bytes // shards // FILE_BYTES)), F.struct(*docs.columns)
    rows = docs.select(
        record.alias("record"), size.alias("size"), slot_of(record, slots).alias("slot"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place"),
    ).join(F.broadcast(slot_map), "slot")
    dealt_by = F.when(F.size("shards") > 1, F.col("place")).otherwise(F.hash("record"))
    chosen = F.element_at("shards", F.pmod("place", F.size("shards")).cast("int") + 1)
    rows.select(
        "record", "size", chosen.alias("shard"), F.pmod(F.hash(dealt_by), F.lit(files)).alias("file")
    ).repartition(shards * files, "shard", "file").drop("file").write.partitionBy("shard").parquet(path)


def _rows(spark: SparkSession, path: str, record: str) -> DataFrame:
    return spark.read.schema(f"record {record}, size long, shard int").parquet(f"{path}/records").select(
        "record", "size", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def save_manifest(spark: SparkSession, path: str) -> None:
    """shard, file, first, n, bytes of every file: its records have the numbers `first` to `first + n - 1`."""
    earlier = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = _rows(spark, path, "struct<>").groupBy("shard", "file").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )
    first = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    files.select("shard", "file", first, "n", "bytes").coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, record: str) -> DataFrame:
    """record, size, shard and slot, the record's number in its shard, from 0 without gaps. `record`: its type.

    The manifest has a row per file; Spark broadcasts it where its size allows that.
    """
    manifest = spark.read.schema("file string, first long").parquet(f"{path}/manifest")
    rows = _rows(spark, path, record).join(manifest, "file")
    return rows.select("record", "size", "shard", (F.col("first") + F.col("row")).alias("slot"))


def shard(docs: DataFrame, path: str, shards: int, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Writes `docs` into shards of nearly equal bytes below `path`, with the map's versions and a manifest of the files.

    Returns record (the whole row), size, shard and slot of every document, read from what was written.
    """
    spark, size = docs.sparkSession, record_size(text)
    total, largest = slot_sizes(docs, size, slots)
    start = first_map(shards, slots)
    save_map(spark, start, f"{path}/map")
    save_map(spark, rebalanced(start, total, largest), f"{path}/map")
    write(docs, load_map(spark, f"{path}/map"), f"{path}/records", shards, int(total.sum()), size, slots)
    save_manifest(spark, path)
    return read(spark, path, docs.select(F.struct(*docs.columns).alias("r")).schema["r"].dataType.simpleString())
