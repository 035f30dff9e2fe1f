"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

Documents are tokenized and cut into pieces of at most CAPACITY tokens; full pieces are
sequences of their own. The others are dealt into blocks of about BLOCK pieces by a hash of
their number, and each block is packed by ISLANDS populations that evolve apart. A child
takes over whole well-filled bins of one parent, drops the bins of the other that share a
document with them, and puts the displaced documents back by best fit. After every epoch the
best packing of each island moves to the next one. Bins that stay badly filled are opened at
the end, and their pieces are packed again, all blocks' together, until one block is left.

Only lengths and numbers take part; tokens stay in the table of pieces. A block is bounded,
so no task holds more than a few dozen kilobytes of packings however large the input is.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows and ids
are pieces of their own; an empty table gives no piece. Extra columns are left out.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import kept, releasing, text_bytes, worker_state

CAPACITY = 4096
END_ID = 1
BLOCK = 2000
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 8
POPULATION = 6
WELL_FILLED = 0.98
KEPT_WORDS, KEPT_LETTERS = 100_000, 120_000  # what each of two generations in a worker remembers; speed only
OPENED = 0.9  # bins filled less than this are opened for the next level

# ---- tokens ---------------------------------------------------------------------------

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?#$%&*|"  # a run of these is one word to the tokenizer, whatever stands before it
WORD = f"^(?P<letters>[{LETTERS}]+)(?P<marks>[{MARKS}]*)$"  # other words go to the tokenizer as they are


class Remembered:
    """A dict that forgets: two generations, the older one goes when the newer is full."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, keys: list) -> list:
        """What is held of each key, or None; all that are held are in `new` from now on."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        values = list(map(self.new.get, keys))
        gaps = unknown(values) if self.old else []
        for i, again in zip(gaps, map(self.old.get, [keys[i] for i in gaps]), strict=True):
            if again is not None:
                values[i] = self.new[keys[i]] = again
        return values

    def put(self, keys: list, values: list, learn) -> None:
        """Fills the gaps that `get` left in `values`, by `learn` of their keys."""
        gaps = unknown(values)
        asked = [keys[i] for i in gaps]
        for i, key, value in zip(gaps, asked, learn(asked) if asked else (), strict=True):
            values[i] = self.new[key] = value


def _byte_names(letters: str) -> str:
    """The characters that name the UTF-8 bytes of small Latin letters in the vocabulary: most bytes their own."""
    names = letters.encode().decode("latin-1")
    return names.replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")


def unknown(values: list) -> list[int]:
    return [i for i, value in enumerate(values) if value is None]


class WordTokens:
    """Token ids of texts, by words.

    The tokenizer never joins characters across white space, so a text's ids are those of its
    words one after the other; each distinct word is tokenized once. Words of Latin letters
    with marks behind them are split here. A run of letters is one word to the tokenizer, and
    small letters are left as they are, so letters go to its model together in one call, as the
    characters that name their bytes in the vocabulary, cut at blanks alone, and are told apart by
    the vocabulary's end-of-word pieces.

    Texts are split and their words numbered by Arrow, so Python sees a run's distinct words only.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.model = Tokenizer.from_file(file)
        self.model.encode_special_tokens = True
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words = Remembered(KEPT_WORDS)
        self.letters = Remembered(KEPT_LETTERS)

    def ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        lines = pc.split_pattern(pa.array([b"\n".join(words).decode().lower()], pa.large_string()), "\n").values
        letters, marks = (part.dictionary_encode() for part in pc.extract_regex(lines, WORD).flatten())
        names = _listed(letters.dictionary)
        held = self.letters.get(names)
        self.letters.put(names, held, self._letters)
        behind = self.ids(_listed(marks.dictionary))
        places = [part.indices.fill_null(0).to_numpy().tolist() for part in (letters, marks)]
        other = np.flatnonzero(letters.indices.is_null().to_numpy(zero_copy_only=False)).tolist()
        found = [held[i] + behind[k] for i, k in zip(*places, strict=True)] if held else [b""] * len(words)
        for i, ids in zip(other, self.ids([words[i].decode() for i in other]), strict=True):
            found[i] = ids
        return found

    def _letters(self, names: list[str]) -> list[bytes]:
        """The ids of runs of small Latin letters."""
        out: list[bytes] = []
        parts = [names[at : at + 200] for at in range(0, len(names), 200)]
        for at in range(0, len(parts), 50):
            some = parts[at : at + 50]
            texts = [_byte_names(" ".join(part)) for part in some]
            for part, e in zip(some, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(cuts) == len(part) and cuts[-1] == 4 * len(ids):
                    data = ids.tobytes()
                    out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
                else:
                    out += self.ids(part)
        return out

    def encode(self, texts: list[bytes]):
        """The ids of each text as little-endian bytes, texts taken in runs of bounded size."""
        run: list[bytes] = []
        size = 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size > 2 << 20:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, run: list[bytes]):
        words = pc.ascii_split_whitespace(pa.array(run, pa.binary()).cast(pa.large_string()))
        numbered = words.values.dictionary_encode()
        distinct = _listed(numbered.dictionary.cast(pa.large_binary()))
        ids = self.words.get(distinct)
        self.words.put(distinct, ids, self._words)
        # every word's ids one after the other: the place of each id among those of the distinct words
        data = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = numbered.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        first = (np.cumsum(sizes) - sizes)[at] - (ends - each)
        found = data[np.arange(len(at) and ends[-1]) + np.repeat(first, each)]
        cuts = np.concatenate([[0], ends])[words.offsets.to_numpy()].tolist()
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield found[start:end].tobytes()


def _listed(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """The pieces of all documents, numbered by `uid` (a kept table).

    `ids` holds the tokens as little-endian numbers, of two bytes each where the vocabulary
    has no larger ones, else of four; `ids_crc32` is that of the four-byte form.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        tokens = worker_state(f"tokens {tokenizer_file}", lambda: WordTokens(tokenizer_file))
        short = len(tokens.ends) <= 1 << 16 and end_id < 1 << 16
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("piece", pa.int32()),
                ("start", pa.int64()),
                ("length", pa.int64()),
                ("ids", pa.binary()),
                ("ids_crc32", pa.int64()),
            ]
        )
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    held = (np.frombuffer(part, "<u4").astype("<u2").tobytes() if short else part) if with_ids else None
                    rows.append((doc_id, n, at // 4, len(part) // 4, held, zlib.crc32(part)))
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)

    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(releasing(cut), PIECES)
    return kept(cut_up.withColumn("uid", F.monotonically_increasing_id()), "pieces")


# ---- packings -------------------------------------------------------------------------

Bins = list[list[int]]


def best_fit(bins: Bins, items: list[int], lengths, capacity: int) -> Bins:
    """Puts each item into the fullest bin that has room for it, or into a new one."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for item in items:
        at = bisect_left(room, (lengths[item], -1))
        if at == len(room):
            bins.append([item])
            insort(room, (capacity - lengths[item], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(item)
            insort(room, (left - lengths[item], k))
    return bins


def fitness(bins: Bins, lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then rather full and empty ones than half-full ones; larger is better."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(into: Bins, giver: Bins, lengths, capacity: int, rng: random.Random) -> Bins:
    """`into` with some well-filled bins of `giver`."""
    full = [b for b in giver if sum(lengths[i] for i in b) >= WELL_FILLED * capacity]
    if not full:
        return into
    first = rng.randrange(len(full))
    taken = full[first : first + rng.randint(1, max(1, len(full) // 2))]
    held = {i for b in taken for i in b}
    whole = [b for b in into if held.isdisjoint(b)]
    displaced = [i for b in into if not held.isdisjoint(b) for i in b if i not in held]
    return best_fit(taken + whole, sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity)


def mutate(bins: Bins, lengths, capacity: int, rng: random.Random) -> Bins:
    """Opens the emptiest bin and a few others and fits their items in again."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    opened = set(order[:1] + rng.sample(order, min(len(order), 3)))
    items = [i for k in sorted(opened) for i in bins[k]]
    rng.shuffle(items)
    items.sort(key=lambda i: -lengths[i])
    return best_fit([b for k, b in enumerate(bins) if k not in opened], items, lengths, capacity)


def first_packings(lengths, capacity: int, rng: random.Random) -> list[Bins]:
    """Best fit in falling order of length, and in shuffled orders."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    found = [best_fit([], order, lengths, capacity)]
    while len(found) < POPULATION and -(-sum(lengths) // capacity) < len(found[0]):
        rng.shuffle(order)
        found.append(best_fit([], order, lengths, capacity))
    return found


def evolve(packings: list[Bins], lengths, capacity: int, rng: random.Random) -> list[Bins]:
    """GENERATIONS of children; the worst packing makes room. Ends early at the lower bound."""
    least = -(-sum(lengths) // capacity)
    ranked = sorted(packings, key=lambda p: fitness(p, lengths, capacity), reverse=True)
    for _ in range(GENERATIONS * POPULATION):
        if len(ranked[0]) <= least:
            break
        one, other = rng.sample(ranked, 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        child = mutate(crossover(one, other, lengths, capacity, rng), lengths, capacity, rng)
        ranked = sorted([*ranked, child], key=lambda p: fitness(p, lengths, capacity), reverse=True)[:POPULATION]
    return ranked


def _numbers(bins: Bins, size: int) -> list[int]:
    out = [0] * size
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(numbers: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return out


ISLAND = pa.schema(
    [
        ("block", pa.int64()),
        ("island", pa.int32()),
        ("uids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("packings", pa.list_(pa.list_(pa.int32()))),
    ]
)
ISLAND_DDL = "block long, island int, uids array<long>, lengths array<long>, packings array<array<int>>"


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Every island's packings, evolved, best first."""

    def step(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                rng = random.Random(f"{row['block']}/{row['island']}/{epoch}")
                lengths = row["lengths"]
                packings = [_bins(p) for p in row["packings"]] or first_packings(lengths, capacity, rng)
                ranked = evolve(packings, lengths, capacity, rng)
                rows.append(row | {"packings": [_numbers(p, len(lengths)) for p in ranked]})
            yield pa.RecordBatch.from_pylist(rows, schema=ISLAND)

    return islands.mapInArrow(step, ISLAND_DDL)


def _migrated(islands: DataFrame) -> DataFrame:
    """The best packing of each island also on the next one of its block."""
    sent = islands.select(
        "block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("packings", 1, 1).alias("elite")
    )
    return islands.join(sent, ["block", "island"]).select(
        "block", "island", "uids", "lengths", F.concat("packings", "elite").alias("packings")
    )


def _pack_blocks(open_pieces: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """uid, length, block, bin, fill of every piece, from the best island of each block."""
    dealt = open_pieces.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items")
    )
    islands = dealt.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.col("items.uid").alias("uids"),
        F.col("items.length").alias("lengths"),
        F.expr("cast(array() as array<array<int>>)").alias("packings"),
    )
    islands = kept(islands.repartition(blocks * ISLANDS, "block", "island") if blocks > 1 else islands, "islands")
    for epoch in range(EPOCHS):
        if epoch:
            islands = _migrated(islands)
        islands = kept(_epoch(islands, capacity, epoch), "islands")

    def best(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bins = _bins(row["packing"])
                loads = [sum(row["lengths"][i] for i in b) for b in bins]
                offsets = [0] * len(row["uids"])
                for b in bins:
                    at = 0
                    for i in b:
                        offsets[i] = at
                        at += row["lengths"][i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["uids"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([row["block"]] * len(offsets), pa.int64()),
                        pa.array(row["packing"], pa.int64()),
                        pa.array([loads[k] / capacity for k in row["packing"]], pa.float64()),
                        pa.array(offsets, pa.int64()),
                    ],
                    names=["uid", "length", "block", "bin", "fill", "offset"],
                )

    chosen = islands.groupBy("block").agg(
        F.min_by(
            F.struct("uids", "lengths", F.element_at("packings", 1).alias("packing")),
            F.struct(F.array_max(F.element_at("packings", 1)), "island"),
        ).alias("best")
    )
    return kept(
        chosen.select("block", "best.*").mapInArrow(
            best, "uid long, length long, block long, bin long, fill double, offset long"
        ),
        "packed",
    )


def place(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """uid, sequence_id, offset of every piece of `lengths` (uid, length)."""
    full = lengths.where(F.col("length") >= capacity)
    done = full.select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = lengths.where(F.col("length") < capacity).select("uid", "length"), 0
    count = rest.count()
    while count:
        blocks = -(-count // BLOCK)
        packed = _pack_blocks(rest, blocks, capacity)
        stays = F.lit(True) if blocks == 1 else F.col("fill") >= OPENED
        number = F.lit(level << 56) + F.col("block") * (1 << 16) + F.col("bin")
        done = done.unionByName(packed.where(stays).select("uid", number.alias("sequence_id"), "offset"))
        rest, level = packed.where(~stays).select("uid", "length"), level + 1
        left = rest.count()
        if left == count:  # nothing can be filled better; as they are
            done = done.unionByName(packed.where(~stays).select("uid", number.alias("sequence_id"), "offset"))
            break
        count = left
    return done


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset of every piece.

    Without `with_ids` the tokens themselves are not kept (`ids` is null).
    """
    cut_up = pieces(docs, tokenizer_file, capacity, end_id, with_ids)
    placed = place(cut_up.select("uid", "length"), capacity)
    return cut_up.join(placed, "uid").drop("uid")
