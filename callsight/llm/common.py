"""Helpers that the operators share: word caches, kept tables, text columns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.session import scratch_path

CACHE_WORDS = 250_000  # entries of a task's word cache before it starts anew; speed only


class WordCache(dict):
    """word -> value, computed once per word; `fresh()` keeps its memory bounded."""

    def __init__(self, value: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, word):
        got = self[word] = self.value(word)
        return got

    def fresh(self) -> WordCache:
        if len(self) > self.most:
            self.clear()
        return self


_worker: dict = {}


def worker_state(key: str, make: Callable):
    """What an operator keeps in a Python worker from task to task. Workers serve one operator
    after the other, so only the last one's state is kept."""
    if key not in _worker:
        _worker.clear()
        release()
        _worker[key] = make()
    return _worker[key]


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def release() -> None:
    """Gives memory that this Python worker has freed back to the system. A worker stays when its task
    has ended, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(task: Callable) -> Callable:
    """`task` of mapInArrow, which releases its memory when it ends."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


# Kept rows can be packed batches of megabytes: a page or row group is measured after a few rows, not after
# 100, and a row group is small, as writers and readers hold one in the heap.
KEPT_OPTIONS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1000",
}


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the folder that the cluster shares and read back.

    Cuts the lineage: a lost executor costs no earlier step, and later steps read the
    same rows as often as they like.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**KEPT_OPTIONS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
