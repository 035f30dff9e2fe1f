"""Benchmark decontamination by full-text indexes of the training texts.

Runs of documents are shards of about SHARD_WORDS words. Over the word numbers of a shard an
FM-index is built: suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet
matrix with packed bits for ranks, and the suffix positions of every SAMPLE-th word. Test
phrases are looked up by backward search, all at once; their occurrences are found by walking
back to a sampled position, and the words they cover are merged into removal spans.

A phrase is a window of WINDOW consecutive words of an item; a shorter item is one phrase.
Documents are closed by marks of their own, so no phrase crosses a border. Equal documents of
a shard are indexed once. Phrases are sent to the tasks in blocks of at most BLOCK_BYTES of
item text, one pass over the documents each; the usual benchmark is one block.

Defined cases: null and empty texts have no words and no hits, null and empty items no
phrase; a null item id with occurrences is counted and listed as the empty string; equal
items all count; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import kept, release, text_bytes, worker_state

WINDOW = 13
SHARD_WORDS = 1 << 19
SAMPLE = 16
BLOCK_BYTES = 16 << 20
CONTAMINATED_SHARE = 20  # one word in so many

# Bytes of words as they are, A-Z made small, all others a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only ties are sorted again.

    Equal suffixes must differ before the end of the text, which the documents' marks ensure.
    """
    n = len(symbols)
    step = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]  # place of the first suffix of a tie
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(tied):
        suffixes = order[tied]
        key = first[tied] * (n + 1) + rank[np.minimum(suffixes + step, n - 1)]
        by = np.argsort(key, kind="stable")
        order[tied], key = suffixes[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[tied] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[order[tied]] = first[tied]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return order


class BitRanks:
    """Packed bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        words[: len(packed)] = packed
        self.words = words.view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Symbol at a place, and occurrences of a symbol before a place, in one step per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            self.levels.append(BitRanks(one))
            self.zeros.append(len(now) - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])
        self.start = np.zeros(1 << bits, np.int64)  # first place of a symbol in the last row
        first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]])) if len(now) else np.zeros(0, int)
        self.start[now[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = self.start[symbol]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.get(at), level.ones(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


class FmIndex:
    """Search and location in a text of whole numbers."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.size = len(symbols)
        bits = max(1, int(n_symbols - 1).bit_length())
        order = suffix_array(symbols, bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.matrix = WaveletMatrix(symbols[order - 1], bits)
        sampled = order % SAMPLE == 0
        self.sampled = BitRanks(sampled)
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase (one phrase a row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.smaller[symbol] + both[: len(alive)]
            high[alive] = self.smaller[symbol] + both[len(alive) :]
            alive = alive[high[alive] > low[alive]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        found, steps, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.sampled.get(rows[open_])
            done = open_[hit]
            found[done] = self.positions[self.sampled.ones(rows[done])] + steps[done]
            open_ = open_[~hit]
            symbol, rank = self.matrix.symbol_and_rank(rows[open_])
            rows[open_] = self.smaller[symbol] + rank
            steps[open_] += 1
        return found


class Numbers(dict):
    """word -> number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Phrases:
    """Distinct phrases of a block of items, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]]):
        held: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - WINDOW + 1) if words else 0):
                held.setdefault(tuple(words[at : at + WINDOW]), set()).add(item)
        self.phrases = sorted(held, key=lambda p: (len(p), p))
        self.items = [sorted(held[p]) for p in self.phrases]


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Removal spans (first word, word behind the last) and items of each document of a shard."""
    nothing = [([], []) for _ in texts]
    numbers = Numbers()
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    symbols = np.empty(starts[-1], np.int64)
    for k, text in enumerate(texts):
        symbols[starts[k] : starts[k + 1] - 1] = np.fromiter(map(numbers.__getitem__, text), np.int64, len(text))
    symbols += len(texts)  # marks come first, each with a number of its own
    symbols[starts[1:] - 1] = np.arange(len(texts))
    known = [k for k, phrase in enumerate(phrases.phrases) if all(w in numbers for w in phrase)]
    if not known:
        return nothing
    index = FmIndex(symbols, len(texts) + len(numbers))
    which, positions, lengths = [], [], []
    for size in sorted({len(phrases.phrases[k]) for k in known}):
        of = np.array([k for k in known if len(phrases.phrases[k]) == size])
        rows = np.array([[numbers[w] for w in phrases.phrases[k]] for k in of]) + len(texts)
        low, high = index.search(rows)
        times = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        which.append(np.repeat(of, times))
        positions.append(index.locate(at))
        lengths.append(np.full(len(at), size))
    which, positions, lengths = map(np.concatenate, (which, positions, lengths))
    if not len(which):
        return nothing
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, positions, 1)
    np.add.at(change, positions + lengths, -1)
    covered = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]]).astype(np.int8)
    edge = np.diff(covered)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found: list = [([], set()) for _ in texts]
    for doc, begin, end in zip(np.searchsorted(starts, begins, "right") - 1, begins, ends, strict=True):
        found[doc][0].append((int(begin - starts[doc]), int(end - starts[doc])))
    docs = np.searchsorted(starts, positions, "right") - 1
    for doc, phrase in np.unique(np.column_stack([docs, which]), axis=0).tolist():
        found[doc][1].update(phrases.items[phrase])
    return [(spans, sorted(items)) for spans, items in found]


def search_texts(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Words, removal spans and items of each text, by shards."""
    out: list = [None] * len(texts)
    shard: dict[bytes, list[int]] = {}  # the text as words, and who has it
    held = 0

    def close() -> None:
        lists = [t.split() for t in shard]
        for words, who, (spans, items) in zip(lists, shard.values(), search_shard(lists, phrases), strict=True):
            for k in who:
                out[k] = (len(words), spans, items)
        shard.clear()

    for k, text in enumerate(texts):
        plain = text.translate(WORD_BYTES)
        if plain not in shard:
            held += plain.count(b" ") + 2
        shard.setdefault(plain, []).append(k)
        if held >= SHARD_WORDS:
            close()
            held = 0
    if shard:
        close()
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = ("n_words", "spans", "items")


def _pass(docs: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
    """`docs` (with the text's bytes as __text) and `ADDED` for one block of items. Only the
    texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    held: list[Phrases] = []

    @F.arrow_udf("struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>")
    def search(texts: pa.Array) -> pa.Array:
        if not held:
            worker_state("decontamination", dict)  # lets go of another operator's
            held.append(Phrases(shared.value))
        found = search_texts(texts.to_pylist(), held[0])
        release()  # the indexes are gone
        return pa.StructArray.from_arrays(
            [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], SPANS),
                pa.array([i for _, _, i in found], pa.list_(pa.string())),
            ],
            list(ADDED),
        )

    found = docs.withColumn("__found", search(F.col("__text")))
    return found.select(*[c for c in docs.columns if c != "__text"], *[F.col(f"__found.{c}").alias(c) for c in ADDED])


def item_blocks(benchmark: DataFrame):
    """(item_id as text, text) lists of at most BLOCK_BYTES, or one longer item; at least one list."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    for row in rows.toLocalIterator():
        text = bytes(row.text)
        if block and held + len(text) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row.item, text))
        held += len(text)
    yield block


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, spans (removal spans, in words), items (ids as text, sorted),
    n_hit, n_items and contaminated."""
    dropped = {*ADDED, "n_hit", "n_items", "contaminated", "__text", "__row"}
    own = [c for c in docs.columns if c not in dropped]
    source = docs.select(*own, text_bytes(text).alias("__text"))
    blocks = item_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _pass(source, first)
    else:  # each pass reads the same numbered rows; only rows with hits meet again
        source = kept(source.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        # a pass is done before the next block comes to the driver
        passes = [kept(_pass(source, block), "hits") for block in chain((first, second), blocks)]
        hits = passes[0].select("__row", "spans", "items").where("size(items) > 0")
        for more in passes[1:]:
            hits = hits.unionByName(more.select("__row", "spans", "items").where("size(items) > 0"))

        @F.arrow_udf("array<struct<start:long,end:long>>")
        def merge(spans: pa.Array) -> pa.Array:
            rows = [merged_spans([(s["start"], s["end"]) for s in row or ()]) for row in spans.to_pylist()]
            return pa.array([[{"start": a, "end": b} for a, b in row] for row in rows], SPANS)

        gathered = hits.groupBy("__row").agg(
            F.flatten(F.collect_list("spans")).alias("__spans"), F.array_sort(F.flatten(F.collect_set("items"))).alias("__items")
        )
        found = (
            passes[0]
            .join(gathered, "__row", "left")
            .withColumn("spans", F.when(F.col("__spans").isNotNull(), merge(F.col("__spans"))).otherwise(F.col("spans")))
            .withColumn("items", F.coalesce(F.array_distinct("__items"), "items"))
            .select(*own, *ADDED)
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    counted = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return counted.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (CONTAMINATED_SHARE * F.col("n_hit") >= F.col("n_words"))
    )
