"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of all orders up to ORDER with a smoothed
unigram estimate:

    P_k(w | h) = m_k * c(h w) / c(h) + (1 - m_k) * P_(k-1)(w | shorter h)
    P_1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

The weight m_k of an order depends on how often the context h was seen (buckets by powers of
two) and is learned by expectation-maximisation on documents of the training part, each
against the counts without itself: its own n-grams, tokens and words are taken out of c, N
and V first. Held-out documents have no share in counts or weights. A context that was never
seen has weight 0. Counts are those of the whole training part: every batch of documents asks
for the totals of its own n-grams (`batches.py`), so frequent n-grams are combined before the
shuffle and no task holds the model.

The weights are a few dozen numbers; a tenth of the training documents, chosen by another hash
of the id, learns them, whatever the size of the table. Only where that tenth has no document at
all, every training document learns.

Defined cases: a null or empty text is its end token alone; a null id counts as the text ''
for the split; without training documents every estimate is the uniform 1; a bucket that no
learning document meets keeps the weight 1/2; rows that repeat are counted and scored each;
extra columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm import batches as B
from callsight.llm.common import kept, releasing

ORDER = 2
HELD_OUT = 10  # one in so many documents is left out of the counts
LEARN = 10  # one in so many training documents learns the weights
ADDED = 0.1
LEVELS = 24  # context-frequency buckets: 1, 2-3, 4-7, ...
ROUNDS = 12

U64 = np.uint64
END = U64(B.word_hash(b"\x00end"))
BEGIN = U64(B.word_hash(b"\x00begin"))
COUNTED, LEARNING, HELD = range(3)  # parts; the first two are the training part


def part_of(doc_id: int | None) -> int:
    name = ("" if doc_id is None else str(doc_id)).encode()
    if zlib.crc32(name) % HELD_OUT == 0:
        return HELD
    return LEARNING if xxhash.xxh3_64_intdigest(name) % LEARN == 0 else COUNTED


def class_bits(order: int) -> int:
    """How many of a key's lowest bits say its order."""
    return (order - 1).bit_length()


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a batch's tokens, each document closed by END, and where documents start."""
    sizes = np.array(row["sizes"], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.empty(starts[-1], np.uint64)
    ends = starts[1:] - 1
    word = np.ones(len(tokens), bool)
    word[ends] = False
    tokens[word] = B.hashes_of(row)
    tokens[ends] = END
    return tokens, starts


def _keys(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the key of the n-gram that ends at each token."""
    firsts = starts[:-1]
    key = B.mix(tokens)
    found, back = [key], tokens
    for k in range(2, order + 1):
        back = np.concatenate([[BEGIN], back[:-1]]) if len(back) else back
        back[firsts] = BEGIN
        key = B.mix(key * U64(0x9E3779B97F4A7C15) + back * U64(2 * k + 1))
        found.append(key)
    low = U64((1 << class_bits(order)) - 1)
    return [(key & ~low) | U64(n) for n, key in enumerate(found)]


def _asked(row: dict, order: int):
    keys = _keys(*_tokens(row), order)
    return np.unique(np.concatenate(keys), return_inverse=True) + (len(keys[0]),)


def _ask(order: int):
    def ask(row: dict):
        distinct, place, _ = _asked(row, order)
        if row["part"] == HELD:
            return distinct, np.zeros(len(distinct), np.int64)
        return distinct, np.bincount(place, minlength=len(distinct))

    return ask


def _counts(row: dict, order: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of the n-gram at each token, of its context, and document starts.

    Both are (order, tokens); the context of order k is the (k-1)-gram one token before, the
    empty one at the start of a document having been seen n_docs times.
    """
    tokens, starts = _tokens(row)
    _, place, size = _asked(row, order)
    own = B.totals_of(row)[place].reshape(order, size)
    return own, _contexts(own, starts, n_docs), starts


def _contexts(own: np.ndarray, starts: np.ndarray, n_docs: int) -> np.ndarray:
    context = np.empty_like(own)
    context[0] = 0
    context[1:, 1:] = own[:-1, :-1]
    context[1:, starts[:-1]] = n_docs
    return context


def _counts_without_itself(row: dict, order: int, n_docs: int, n: int, v: int):
    """Like `_counts`, each document's own n-grams taken out; then N and V of each token's document."""
    own, _, starts = _counts(row, order, n_docs)
    distinct, place, size = _asked(row, order)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = np.tile(doc, order) * len(distinct) + place.ravel()
    _, first, at, times = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
    left = own - times[at].reshape(order, size)
    firsts = first[first < size]  # where a document has a word for the first time
    only_here = np.bincount(doc[firsts], left[0, firsts] == 0, len(starts) - 1)
    return left, _contexts(left, starts, n_docs - 1), n - np.diff(starts)[doc], v - only_here[doc]


def level(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency; 0 for none."""
    return np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1)


def _estimates(own, context, n, v) -> tuple[np.ndarray, np.ndarray]:
    """Base probabilities, and the maximum-likelihood estimates of the higher orders."""
    base = (own[0] + ADDED) / (n + ADDED * (v + 1))
    return base, own[1:] / np.maximum(context[1:], 1)


def mixture(base: np.ndarray, ratios: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities; `weights` holds the weight of every higher order at each token."""
    p = base
    for ratio, weight in zip(ratios, weights, strict=True):
        p = weight * ratio + (1 - weight) * p
    return p


def chosen_weights(mix: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return np.stack([m[k] for m, k in zip(mix, levels, strict=True)]) if len(mix) else np.zeros((0, levels.shape[-1]))


def expected(base, ratios, levels, mix) -> np.ndarray:
    """What the tokens add for each order and bucket: expected uses of the order, and of it or a lower one."""
    sums = np.zeros((len(mix), LEVELS, 2))
    weights = chosen_weights(mix, levels)
    partial = [base]
    for ratio, weight in zip(ratios, weights, strict=True):
        partial.append(weight * ratio + (1 - weight) * partial[-1])
    reach = np.ones(len(base))  # probability that this order is asked at all
    for k in range(len(mix) - 1, -1, -1):
        used = reach * weights[k] * ratios[k] / partial[k + 1]
        sums[k, :, 0] = np.bincount(levels[k], used, LEVELS)
        sums[k, :, 1] = np.bincount(levels[k], reach, LEVELS)
        reach = reach - used
    return sums


def _learned(learning: DataFrame, order: int) -> np.ndarray:
    """Mixture weights by order and bucket. An iteration sends LEVELS * 2 sums per order and task."""
    mix = np.full((order - 1, LEVELS), 0.5)
    mix[:, 0] = 0.0
    if order < 2:
        return mix
    for _ in range(ROUNDS):
        now = mix.copy()

        def step(batches, now=now):
            sums = np.zeros((order - 1, LEVELS, 2))
            for batch in batches:
                for row in B.rows_of(batch):
                    size = row["size"]
                    base = np.frombuffer(row["base"], "<f4").astype(float)
                    ratios = np.frombuffer(row["ratios"], "<f4").astype(float).reshape(order - 1, size)
                    levels = np.frombuffer(row["levels"], np.uint8).reshape(order - 1, size)
                    sums += expected(base, ratios, levels, now)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())], names=["slot", "value"]
            )

        rows = learning.mapInArrow(step, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros((order - 1) * LEVELS * 2)
        for row in rows:
            sums[row.slot] = row.value
        sums = sums.reshape(order - 1, LEVELS, 2)
        seen = sums[:, :, 1] > 0
        mix = np.where(seen, sums[:, :, 0] / np.where(seen, sums[:, :, 1], 1), mix)
        mix[:, 0] = 0.0
    return mix


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = B.word_batches(docs, part_of)
    sums = rows.groupBy("part").agg(
        F.sum(F.col("n_tokens") + F.size("sizes")).alias("tokens"), F.sum(F.size("sizes").cast("long")).alias("docs")
    )
    seen = {r.part: r for r in sums.collect()}
    training = [seen[part] for part in (COUNTED, LEARNING) if part in seen]
    n, n_docs = sum(r.tokens for r in training), sum(r.docs for r in training)
    classes = 1 << class_bits(order)
    totals = B.total_counts(rows, _ask(order), order * sum(r.tokens for r in seen.values()), classes)
    v = B.filled_keys(totals, classes)[0]

    def events(batches):
        for batch in batches:
            for row in B.rows_of(batch):
                own, context, without, words = _counts_without_itself(row, order, n_docs, n, v)
                base, ratios = _estimates(own, context, without, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(base)], pa.int64()),
                        pa.array([base.astype("<f4").tobytes()], pa.binary()),
                        pa.array([ratios.astype("<f4").tobytes()], pa.binary()),
                        pa.array([level(context[1:]).astype(np.uint8).tobytes()], pa.binary()),
                    ],
                    names=["size", "base", "ratios", "levels"],
                )

    chosen = F.col("part") == LEARNING if LEARNING in seen else F.col("part") != HELD
    learning = B.with_totals(rows.where(chosen), totals)
    mix = _learned(kept(learning.mapInArrow(releasing(events), "size long, base binary, ratios binary, levels binary"), "learning"), order)

    def scores(batches):
        for batch in batches:
            for row in B.rows_of(batch):
                own, context, starts = _counts(row, order, n_docs)
                base, ratios = _estimates(own, context, n, v)
                p = mixture(base, ratios, chosen_weights(mix, level(context[1:])))
                firsts = starts[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["part"] == HELD] * len(firsts), pa.bool_()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(np.add.reduceat((own[0] > 0).astype(np.int64), firsts), pa.int64()),
                        pa.array(np.full(len(firsts), n), pa.int64()),
                        pa.array(np.add.reduceat(np.log10(base), firsts)),
                        pa.array(np.add.reduceat(np.log10(p), firsts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return B.with_totals(rows, totals).mapInArrow(
        releasing(scores),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
