"""N-gram Jaccard join on prefix trees.

A document's set holds its distinct 4-word shingles. Documents link when their sets have a
Jaccard similarity of LEAST percent or more; a group is what links connect.

1. How many sets hold a shingle is counted over the whole corpus (`batches.py`), by the
   shingle's highest bits, KEY_BITS more than it takes to number all: two that share them
   share a count, which changes the order of shingles but nothing else. A set is ordered
   from its rarest shingle on; two sets that link share one among their first
   n - ceil(t n) + 1. Sets whose first shingles are all their own drop out here.
2. Sets that share such a shingle are connected, which gives clusters that hold every link.
3. A cluster's sets are stored in a trie, commonest shingle first, so that alike sets share
   long paths. Each set runs through the trie once: the overlap of a path is counted for all
   sets below it, and a subtree is left when its remaining lengths cannot give enough
   overlap, when its sets have all run themselves, or when all are in the group already.
   Clusters of more than BLOCK sets or CELL_SHINGLES shingles are cut into blocks, and a task
   gets two blocks; so no task holds an unbounded cluster, and no pair of sets is left out.
4. Links found in tasks are connected across them.

Equal sets are one node from the start, so copies make no pairs.

Defined cases: a text without words, or null, has the empty set and is its own group; fewer
than four words are one shingle; repeated rows and ids are linked by their equal sets; a null
id never names a group that has another one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm import batches as B
from callsight.llm.common import kept, releasing
from callsight.llm.components import components

SHINGLE = 4
LEAST = 85  # percent
BLOCK = 2048
CELL_SHINGLES = 4_000_000
KEY_BITS = 12

U64 = np.uint64


def shingle_sets(row: dict) -> list[np.ndarray]:
    """The set of each document of a batch, as rising 64-bit numbers."""
    words = B.mix(B.hashes_of(row))
    starts = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
    keys = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        keys = B.mix(keys * U64(0x9E3779B97F4A7C15) + words[k : k + len(keys)] + U64(k))
    out = []
    for start, end in zip(starts, starts[1:], strict=False):
        if end - start >= SHINGLE:
            out.append(np.unique(keys[start : end - SHINGLE + 1]))
        elif end > start:
            one = U64(end - start)
            for word in words[start:end]:
                one = B.mix(np.array([one * U64(31)]) + word)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _distinct(sets: list[np.ndarray]) -> tuple[list[bytes], list[int]]:
    """Fingerprint of each set, and the first place of each fingerprint."""
    prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    first: dict[bytes, int] = {}
    for k, p in enumerate(prints):
        first.setdefault(p, k)
    return prints, [k for p, k in first.items() if len(sets[k])]


def _asked(sets: list[np.ndarray], chosen: list[int], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The counted keys of a batch's distinct sets, and how many of these sets have each."""
    if not chosen:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([sets[k] for k in chosen]) >> U64(shift), return_counts=True)


SET = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("mark", pa.int64()),
        ("n_shingles", pa.int64()),
        ("print", pa.binary()),
        ("shingles", pa.binary()),
        ("rare", pa.list_(pa.int64())),
    ]
)
SET_DDL = "doc_id long, mark long, n_shingles long, print binary, shingles binary, rare array<long>"


def first_shared(shingles: np.ndarray, times: np.ndarray, least: int) -> np.ndarray:
    """Of the shingles by which a linked set can be found, those that other sets have."""
    order = np.lexsort((shingles, times))
    size = len(shingles)
    first = order[: size - -(-least * size // 100) + 1]
    return shingles[first[times[first] > 1]]


def sets_of(docs: DataFrame, least: int) -> DataFrame:
    """A row per document; sets that may have links come with their shingles (a kept table)."""
    rows = B.word_batches(docs)
    n_words = rows.agg(F.sum("n_tokens").alias("n")).first().n or 0
    bits = min(62, int(n_words).bit_length() + KEY_BITS)
    shift = 64 - bits

    def ask(row):
        with np.errstate(over="ignore"):
            sets = shingle_sets(row)
        return _asked(sets, _distinct(sets)[1], shift)

    totals = B.total_counts(rows, ask, n_words, bits=bits)

    def emit(batches):
        for batch in batches:
            for row in B.rows_of(batch):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(row)
                prints, chosen = _distinct(sets)
                asked, _ = _asked(sets, chosen, shift)
                times = B.totals_of(row)
                held: list = [None] * len(sets)
                rare: list = [None] * len(sets)
                for k in chosen:
                    shared = first_shared(sets[k], times[np.searchsorted(asked, sets[k] >> U64(shift))], least)
                    if len(shared):
                        held[k], rare[k] = sets[k].tobytes(), shared.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["marks"], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(held, pa.binary()),
                        pa.array(rare, pa.list_(pa.int64())),
                    ],
                    schema=SET,
                )

    return kept(B.with_totals(rows, totals).mapInArrow(releasing(emit), SET_DDL), "sets")


def clusters(sets: DataFrame) -> DataFrame:
    """node, root: fingerprints connected by the shingles that they can be found by."""
    found_by = sets.where("rare is not null").select("print", F.explode("rare").alias("shingle")).distinct()
    first = found_by.groupBy("shingle").agg(F.min("print").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = found_by.join(first, "shingle").select(F.col("print").alias("a"), F.col("first").alias("b"))
    return components(links)


# ---- the trie of a task ---------------------------------------------------------------


class Trie:
    """Ordered sets as a trie with joined edges.

    Sets lie in lexicographic order, so a node is a run of them: `low`, `high`, the path's
    length above it and with it, the runs of its children, and the smallest and largest set.
    """

    def __init__(self, paths: list[np.ndarray]):
        self.paths = paths
        size = np.array([len(p) for p in paths])
        common = np.zeros(len(paths), np.int64)  # with the set before
        for k in range(1, len(paths)):
            a, b = paths[k - 1], paths[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[k] = differ[0] if len(differ) else m
        self.nodes: list[tuple[int, int, int, int, int, int, list[int]]] = []
        self.roots = self._split(0, len(paths), 0, common, size)

    def _split(self, low, high, depth, common, size) -> list[int]:
        roots: list[int] = []
        open_ = [(low, high, depth, roots)]
        while open_:
            low, high, depth, into = open_.pop()
            cuts = [low, *(np.flatnonzero(common[low + 1 : high] <= depth) + low + 1).tolist(), high]
            for a, b in zip(cuts, cuts[1:], strict=False):
                end = int(common[a + 1 : b].min()) if b - a > 1 else int(size[a])
                children: list[int] = []
                into.append(len(self.nodes))
                self.nodes.append((a, b, depth, end, int(size[a:b].min()), int(size[a:b].max()), children))
                inner = a + 1 if size[a] == end else a  # that set ends here
                if b > inner and b - a > 1:
                    open_.append((inner, b, end, children))
        return roots


def grouped(sets: list[np.ndarray], least: int) -> np.ndarray:
    """For each of the distinct sets, the number of its group: the smallest index in it."""
    count = len(sets)
    shingles, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(shingles), np.int64)
    rank[np.lexsort((shingles, -times))] = np.arange(len(shingles))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    paths = [np.sort(p) for p in np.split(rank[place], cuts)]
    order = sorted(range(count), key=lambda k: paths[k].astype(">u4").tobytes())
    trie = Trie([paths[k] for k in order])
    label = np.arange(count)
    ran = np.zeros(count, bool)
    has = np.zeros(len(shingles), bool)
    weight = [times[np.unique(place_)].mean() if len(place_) else 0 for place_ in np.split(place, cuts)]
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    for x in sorted(range(count), key=lambda k: -weight[order[k]]):  # those with the commonest shingles first
        path, size = trie.paths[x], len(trie.paths[x])
        has[path] = True
        passed = np.concatenate([[0], np.cumsum(ran)])
        joined = False
        open_ = [(node, 0) for node in trie.roots]
        while open_:
            node, overlap = open_.pop()
            low, high, above, depth, smallest, largest, children = trie.nodes[node]
            if passed[high] - passed[low] == high - low:
                continue
            if label[low] == label[x] and changes[high - 1] == changes[low] and not joined:
                continue
            edge = trie.paths[low][above:depth]
            overlap += int(np.count_nonzero(has[edge]))
            rest = size - int(np.searchsorted(path, edge[-1], "right"))
            best = min(max(depth + rest, smallest), largest)
            if (100 + least) * (overlap + min(best - depth, rest)) < least * (size + best):
                continue
            if len(trie.paths[low]) == depth and low != x and label[low] != label[x]:
                if 100 * overlap >= least * (size + depth - overlap):
                    label[label == max(label[low], label[x])] = min(label[low], label[x])
                    joined = True
            open_.extend((child, overlap) for child in children)
        has[path] = False
        ran[x] = True
        if joined:
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    out = np.empty(count, np.int64)
    out[order] = label
    least_of = np.full(count, count)
    np.minimum.at(least_of, out, np.arange(count))
    return least_of[out]


def links_in_clusters(sets: DataFrame, of: DataFrame, least: int) -> DataFrame:
    """a, b: sets of the same group, found by tasks that hold at most two blocks of a cluster."""
    members = sets.where("shingles is not null").select("print", "n_shingles", "shingles")
    sized = (
        sets.where("shingles is not null")
        .select("print", "n_shingles")
        .distinct()
        .join(of, F.col("print") == F.col("node"))
        .groupBy("root")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
        .where("n > 1")
        .select("root", F.ceil(F.greatest(F.col("n") / (2 * BLOCK), F.col("total") / CELL_SHINGLES)).alias("half"))
        .select("root", F.when(F.col("half") > 1, 2 * F.col("half")).otherwise(1).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            others,
            lambda k: F.least(k, F.col("block")).cast("long") * F.col("blocks") + F.greatest(k, F.col("block")),
        )
    )
    placed = (
        members.join(of, F.col("print") == F.col("node"))
        .join(sized, "root")
        .withColumn("block", block)
        .select("root", F.explode(cells).alias("cell"), "print", "shingles")
        .repartition("root", "cell")
        .sortWithinPartitions("root", "cell", "print")
    )

    def join(batches):
        key, prints, sets_ = None, [], []

        def close():
            if len(prints) > 1:
                groups = grouped(sets_, least)
                pairs = [(k, g) for k, g in enumerate(groups.tolist()) if k != g]
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([prints[k] for k, _ in pairs], pa.binary()),
                            pa.array([prints[g] for _, g in pairs], pa.binary()),
                        ],
                        names=["a", "b"],
                    )

        for batch in batches:
            for row in B.rows_of(batch):
                now = (row["root"].to_pybytes(), row["cell"])
                if now != key:
                    yield from close()
                    key, prints, sets_ = now, [], []
                name = row["print"].to_pybytes()
                if not prints or prints[-1] != name:  # copies of other batches come together
                    prints.append(name)
                    sets_.append(np.frombuffer(row["shingles"].to_pybytes(), np.uint64))
        yield from close()

    return placed.mapInArrow(releasing(join), "a binary, b binary")


def groups(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, mark, n_shingles, group of every row of `docs` (doc_id, text) that has a word.

    `mark` is `batches.text_mark` of the row's text, `group` the name of its component.
    """
    return _grouped(sets_of(docs, least), least)


def _grouped(sets: DataFrame, least: int) -> DataFrame:
    roots = components(links_in_clusters(sets, clusters(sets), least))
    return (
        sets.where("n_shingles > 0")
        .select("doc_id", "mark", "n_shingles", "print")
        .join(roots, F.col("print") == F.col("node"), "left")
        .select("doc_id", "mark", "n_shingles", F.coalesce("root", "print").alias("group"))
    )


def join(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text)."""
    sets = sets_of(docs, least)
    grouped_rows = _grouped(sets, least).drop("mark")
    smallest = grouped_rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    found = grouped_rows.join(smallest, "group").select("doc_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)
