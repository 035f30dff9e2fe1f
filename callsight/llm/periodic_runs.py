"""Periodic runs: stretches of a text in which the same words come again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a
length of at least max(6, 4 q) that no neighbouring word extends keeping the period. It is
found by seed and extension on diagonals, where the diagonal of lag q pairs word i with i + q:

* A run of period q covers at least max(6, 4 q) - q words of the diagonal q. Periods are cut
  into levels `first ... size`, where `size` is that guaranteed overlap of the level's smallest
  period, so every run of the level holds a pair of equal `size`-grams q words apart.
* The index of a level names all `size`-grams of the text (exact names, built by doubling from
  those of half the width) and sorts them by name and place. A gram is at least as long as the
  level's periods, and a primitive block equals none of its own rotations, so inside a run a
  gram's next occurrence is exactly one period on: pairs of neighbours in the index are all
  that is needed, at most one per word, whatever the number of occurrences.
* A pair is a seed. The table of the furthest place covered per lag drops seeds inside an
  earlier extension; the others are extended both ways along their diagonal.

Levels grow threefold, so a text of n words takes O(n log^2 n), and stops early where all
grams of some width differ. A task holds one text at a time.

Defined cases: a null text, or one without words, has no runs and the collapsed text ''; rows
that repeat are each answered; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import text_bytes

LEAST_WORDS = 6
LEAST_PERIODS = 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = [("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.binary())]
FOUND_DDL = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>"


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def levels(n: int) -> Iterator[tuple[int, int]]:
    """The smallest period of every level and its guaranteed overlap, also the level's largest period."""
    first = 1
    while least_length(first) <= n:
        size = least_length(first) - first
        yield first, size
        first = size + 1


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left * (int(right.max()) + 1) + right


def _equal_steps(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries are equal; looks at twice as many each time."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at += step
        step *= 2
    return n


def _extended(codes: np.ndarray, at: int, size: int, lag: int) -> tuple[int, int]:
    """The words from `start` to `end` around a seed that equal those `lag` later."""
    end = at + size + _equal_steps(codes[at + size : len(codes) - lag], codes[at + size + lag :])
    back = _equal_steps(codes[:at][::-1], codes[lag : at + lag][::-1])
    return at - back, end


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    found: list[tuple[int, int, int]] = []
    if n < LEAST_WORDS:
        return found
    codes = names = numbers(words)
    width = 1
    for first, size in levels(n):
        while 2 * width <= size:
            distinct, names = np.unique(_pairs(names[:-width], names[width:]), return_inverse=True)
            width *= 2
            if len(distinct) == len(names):  # nothing as long as this occurs twice
                return sorted(found)
        key = _pairs(names[: n - size + 1], names[size - width : n - width + 1])
        order = np.argsort(key, kind="stable")
        lag = np.diff(order)
        seeds = np.flatnonzero((np.diff(key[order]) == 0) & (lag >= first) & (lag <= size))
        if not len(seeds):
            continue
        lag, place = lag[seeds], order[seeds]
        by_place = np.argsort(place)
        covered: dict[int, int] = {}  # lag -> where the last extension on its diagonal ended
        for at, q in zip(place[by_place].tolist(), lag[by_place].tolist(), strict=True):
            if at < covered.get(q, 0):
                continue
            start, end = _extended(codes, at, size, q)
            covered[q] = end
            if end + q - start >= least_length(q):
                found.append((start, end + q - start, q))
    return sorted(found)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that come after the first period of a run."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)


def _found(text: bytes) -> tuple:
    words = text.split()
    runs = find_runs(words)
    return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapse(words, runs)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, runs (by start, then period) and collapsed, the text without repeats."""

    @F.arrow_udf(FOUND_DDL)
    def search(texts: pa.Array) -> pa.Array:
        rows = [_found(t) for t in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(FOUND)
        return pa.StructArray.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(columns, FOUND, strict=True)], [name for name, _ in FOUND]
        )

    added = [name for name, _ in FOUND]
    searched = docs.withColumn("__found", search(text_bytes(text)))
    own = [F.col(c) for c in docs.columns if c not in added]
    return searched.select(
        *own, "__found.n_words", "__found.runs", F.col("__found.collapsed").cast("string").alias("collapsed")
    )
