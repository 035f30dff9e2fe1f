"""Quality rules: does a document look like its language?

Every document gives two histograms: its characters by class, and its words by common-word
bucket. Both are compared with the histograms of all documents of the same language by the
Jensen-Shannon distance (base 2, so 0 ... 1). A histogram of few words is far from any
reference by chance alone, so the limits fall with the length; texts of a few dozen
characters, or of fewer words than the base rule wants, are not compared.

References cover the whole corpus. Words are counted in a fixed number of buckets by their
CRC-32, so what a task sends is bounded by the number of buckets and languages, not by the
vocabulary; the `COMMON` fullest buckets of a language are its common words.

Defined cases: a null or empty text has no words and fails the base rule; a language code
that is null, or not two or three small letters, counts as `und`; columns of the input that
have the name of an added column are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.llm.common import WordCache, releasing, text_bytes, worker_state

BUCKETS = 4096
COMMON = 64
CLASSES = 8
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
JUDGED_CHARS = 40  # fewer characters are not compared with a reference
MAX_CLASS_DISTANCE = 0.27  # between good (at most 0.215) and symbol junk (0.327 on) of 100 words or more
MAX_WORD_DISTANCE = 0.5

SYMBOLS = b"#*$%&|<>"
SPACES = bytes([9, 10, 11, 12, 13, 32])
FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not start a code point


def _class_table() -> np.ndarray:
    """Class of a byte: lower, upper, digit, blank, line end, sentence mark, other ASCII, rest."""
    classes = np.full(256, 7, np.uint8)
    classes[:128] = 6
    classes[list(b",.;:!?'\"()-")] = 5
    classes[ord("\n")] = 4
    classes[list(b" \t\r\x0b\x0c")] = 3
    classes[ord("0") : ord("9") + 1] = 2
    classes[ord("A") : ord("Z") + 1] = 1
    classes[ord("a") : ord("z") + 1] = 0
    classes[list(FOLLOWING)] = CLASSES  # left out
    return classes


CLASS_OF = _class_table()


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def bucket_numbers(words: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.int32, len(words))


def language(name: str = "lang") -> Column:
    return F.when(F.col(name).rlike("^[a-z]{2,3}$"), F.col(name)).otherwise("und")


@dataclass
class Reference:
    """Shares of a language: character classes; common buckets, then all others."""

    classes: np.ndarray
    slot: np.ndarray  # bucket -> place in `words`, COMMON for the rest
    words: np.ndarray


def references(docs: DataFrame) -> dict[str, Reference]:
    """One reference per language, of all documents.

    The driver gets CLASSES + COMMON + 1 numbers per language, of which there are at most
    26^2 + 26^3 + 1: a few dozen megabytes at the very worst.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        cache = worker_state("buckets", lambda: WordCache(bucket))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = sums.setdefault(lang, np.zeros(CLASSES + BUCKETS, np.int64))
                total[:CLASSES] += class_counts(text)
                numbers = bucket_numbers(text.lower().split(), cache.fresh())
                total[CLASSES:] += np.bincount(numbers, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "slot", "n"],
            )

    counts = (
        docs.select(language().alias("lang"), text_bytes().alias("text"))
        .mapInArrow(releasing(count), "lang string, slot int, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    kind = F.col("slot") < CLASSES
    of = Window.partitionBy("lang", kind)  # at most BUCKETS rows
    rows = (
        counts.withColumn("total", F.sum("n").over(of))
        .withColumn("rank", F.row_number().over(of.orderBy(F.desc("n"), "slot")))
        .where(kind | (F.col("rank") <= COMMON))
        .orderBy("lang", "rank", "slot")
        .collect()
    )
    found: dict[str, Reference] = {}
    for row in rows:
        ref = found.setdefault(
            row.lang, Reference(np.zeros(CLASSES), np.full(BUCKETS, COMMON, np.int32), np.zeros(COMMON + 1))
        )
        if row.slot < CLASSES:
            ref.classes[row.slot] = row.n / row.total
        else:
            ref.slot[row.slot - CLASSES] = row["rank"] - 1
            ref.words[row["rank"] - 1] = row.n / row.total
    for ref in found.values():
        ref.words[COMMON] = max(0.0, 1.0 - ref.words[:COMMON].sum()) if ref.words.any() else 0.0
    return found


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    return max(0.0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2) ** 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that the text holds twice or more, each counted once."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 5 - max(at, end)
            end = at + 5
    return covered


def measure(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text.translate(None, SPACES + FOLLOWING)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def distances(text: bytes, words: list[bytes], ref: Reference, cache: WordCache) -> tuple[float, float]:
    classes = class_counts(text)
    numbers = ref.slot[bucket_numbers(words, cache)]
    return (
        js_distance(classes / classes.sum(), ref.classes),
        js_distance(np.bincount(numbers, minlength=COMMON + 1) / len(words), ref.words),
    )


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
ADDED = f"{MEASURES}, base_failed boolean, class_distance double, word_distance double, kept boolean"


def limits(n_words: int, n_chars: int) -> tuple[float, float]:
    """The largest class and word distances of a text that looks like its language."""
    return max(MAX_CLASS_DISTANCE, 0.2 + 36 / n_chars), max(MAX_WORD_DISTANCE, 0.38 + 1.2 / n_words**0.5)


def _judge(text, lang, refs, cache) -> tuple:
    words = text.split()
    counts = measure(text, words)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    far, strange = (None, None), False
    n_chars = len(text.translate(None, FOLLOWING))
    if counts[0] >= MIN_WORDS and n_chars >= JUDGED_CHARS and lang in refs:
        far = distances(text, text.lower().split(), refs[lang], cache)
        most = limits(counts[0], n_chars)
        strange = far[0] > most[0] or far[1] > most[1]
    return (*counts, failed, *far, not failed and not strange)


def judge(docs: DataFrame, refs: dict[str, Reference]) -> DataFrame:
    """`docs` with the counts, distances and verdict of every document (columns `ADDED`)."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    names = [part.split()[0] for part in ADDED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    @F.arrow_udf(f"struct<{', '.join(p.replace(' ', ':') for p in ADDED.split(', '))}>")
    def verdicts(text: pa.Array, lang: pa.Array) -> pa.Array:
        cache = worker_state("buckets", lambda: WordCache(bucket))
        rows = [
            _judge(t, x, shared.value, cache.fresh())
            for t, x in zip(text.to_pylist(), lang.to_pylist(), strict=True)
        ]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )

    judged = docs.withColumn("__verdict", verdicts(text_bytes(), language()))
    own = [F.col(c) for c in docs.columns if c not in names]
    return judged.select(*own, *[F.col(f"__verdict.{n}").alias(n) for n in names])


def rules(docs: DataFrame) -> DataFrame:
    """`judge` against references made of the same documents."""
    return judge(docs, references(docs))
