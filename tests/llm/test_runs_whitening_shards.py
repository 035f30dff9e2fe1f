"""Periodic runs, whitening and sharding against brute force, with odd rows and hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from callsight.llm import periodic_runs, queries, sharding, whitening
from callsight.llm.common import table
from callsight.session import scratch_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .conftest import LONG, ODD_TEXTS

SPACE = re.compile("[^\x20\x09-\x0d]+")


# ---- periodic runs


def plain_runs(words):
    """Every lag, every stretch; a stretch counts at its smallest period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                if all(any(words[x] != words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found)


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), st.integers(1, 9), st.integers(0, 70))
def test_runs_of_few_words(words, period, start):
    """Few words, so that repeats are frequent; from `start` on they repeat with `period`."""
    for text in (words, [w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)]):
        assert periodic_runs.find_runs(text) == plain_runs(text)


@pytest.mark.parametrize("period", [1, 5, 6, 18, 19, 57, 58, 171, 172, 600])
def test_runs_at_the_edges_of_levels(period):
    block = [b"%d" % i for i in range(period)]
    for length in (max(6, 4 * period) - 1, max(6, 4 * period), 5 * period + 6):
        words = [b"x", *(block * 12)[:length], b"y"]
        want = [(1, length, period)] if length >= max(6, 4 * period) else []
        assert periodic_runs.find_runs(words) == want


def test_runs_of_a_very_long_text():
    words = [b"w%d" % (i % 701) for i in range(300_000)]
    assert periodic_runs.find_runs(words) == [(0, 300_000, 701)]
    assert periodic_runs.find_runs([b"a"] * 200_000) == [(0, 200_000, 1)]


def plain_run_row(doc_id, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [tuple(r) for r in periodic_runs.find_runs([w.encode() for w in words])] if n > 2000 else plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(plain_collapsed(words, runs)))


def test_run_query_equals_the_plain_version(spark, sf):
    docs = table(spark, sf, "documents").where("length(text) < 4000")
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    rows = [plain_run_row(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) > 100 and all(got[r[0]] == r for r in rows) and any(r[1] for r in rows)


def test_runs_on_odd_rows(odd, nothing):
    got = periodic_runs.with_runs(odd.withColumn("runs", F.lit("mine"))).collect()
    assert len(got) == len(ODD_TEXTS)
    for r in got:
        words = SPACE.findall(r.text or "")
        if r.text != LONG:
            assert [tuple(x) for x in r.runs] == plain_runs(words)
            assert r.collapsed == " ".join(plain_collapsed(words, plain_runs(words)))
        assert r.n_words == len(words) and r.toxic == "t"
    assert periodic_runs.with_runs(nothing).count() == 0


# ---- whitening


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 24), st.sampled_from(["normal", "few", "zero", "wide"]))
def test_rank_one_change_of_a_spectrum(seed, k, kind):
    rng = np.random.default_rng(seed)
    d = {"normal": rng.normal(size=k), "few": rng.integers(0, 3, k) * 1.0, "zero": np.zeros(k), "wide": 10.0 ** rng.integers(-8, 8, k)}[kind]
    d = np.sort(d)
    basis = np.linalg.qr(rng.normal(size=(k, k)))[0] if seed % 3 else np.eye(k)
    y = rng.normal(size=k) * 10.0 ** rng.integers(-6, 6)
    y[rng.random(k) < 0.2] = 0
    rho = 10.0 ** rng.integers(-3, 4)
    values, vectors = whitening.update(d, basis, rho, y)
    whole = basis @ np.diag(d) @ basis.T + rho * np.outer(y, y)
    assert np.all(np.diff(values) >= 0)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() <= 1e-12 * max(np.abs(whole).max(), 1e-300)


def test_spectra_are_exact_before_the_refinement():
    """The incremental part alone gives the eigenvalues, in one go or merged from uneven parts."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(700, 16)) * rng.integers(1, 90, 16)).astype(np.int64)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True)) * len(x)
    parts = []
    for a, b in ((0, 700), (0, 1), (1, 9), (9, 500), (500, 700), (700, 700)):
        spectrum = whitening.Spectrum.empty(16)
        for row in x[a:b]:
            spectrum.add(row)
        parts.append(spectrum)
    whole, *some = parts
    for other in some[1:]:
        some[0].merge(other)
    for s in (whole, some[0]):
        assert s.n == 700 and (s.sums == x.sum(0)).all()
        assert s.values == pytest.approx(want, rel=1e-10)


def plain_whitening(rows):
    """(vec_id, x) rows -> n, sums, eigenvalues and vectors (falling), trace, deviations."""
    valid = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    x = np.array(sorted({tuple(v) for _, v in valid}), dtype=float)
    mean = x.mean(0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    sums = [int(s) for s in x.sum(0)]
    deviation = [sum((len(x) * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for _, v in valid]
    white = (np.array([v for _, v in valid]) - mean) @ (vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)))
    return len(x), values[::-1], white, deviation


def test_whitening_query_equals_the_plain_version(spark, sf):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table(spark, sf, "embeddings").collect()]
    n, values, white, deviation = plain_whitening(rows)
    place = {i: k for k, (i, _) in enumerate(rows)}
    got = queries.op12_whitening(spark, sf).collect()
    assert Counter(r.vec_id for r in got) == Counter({i: 4 for i, _ in rows})
    signs = {}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-10) and r.identity_error < 1e-10
        sign = signs.setdefault(c, 1 if r.whitened * white[k, c] > 0 else -1)
        assert r.whitened == pytest.approx(sign * white[k, c], abs=1e-8)


def whitened(spark, rows, ddl="vec_id long, embedding array<float>, whitened string, x int, part int"):
    vectors = spark.createDataFrame([(*r, "mine", 1, 2) for r in rows], ddl).repartition(3)
    model = whitening.fit(vectors, "embedding")
    return model, whitening.transform(vectors, model, "embedding").collect()


def test_whitening_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k % 3 - 0.5, (k * k % 7) / 7, -(k % 5) / 3]) for k in range(40)] + [(None, [0.0, -0.0, 5.0])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 1.0]), (103, [0.0, -inf, 1.0]), (104, []), (105, [1.0]), (106, [1.0, 2.0, 3.0, 4.0])]
    model, got = whitened(spark, [*good, *bad, *good[:9], *[good[3]] * 60])
    n, values, white, deviation = plain_whitening([(i, [float(np.float32(c)) for c in v]) for i, v in good])
    assert model.n == n and model.eigenvalues == pytest.approx(values[:3], rel=1e-9) and model.identity_error < 1e-9
    assert Counter(r.vec_id for r in got) == Counter([*(i for i, _ in good), *range(9), *[3] * 60])
    want = dict(zip((i for i, _ in good), deviation, strict=True))
    assert all(r.deviation == want[r.vec_id] and len(r.whitened) == 3 and r.part == 2 for r in got)


@pytest.mark.parametrize("rows, dims", [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2), ([(1, [0.0]), (2, [1e30])], 1)])
def test_whitening_without_spread_or_rows(spark, rows, dims):
    model, got = whitened(spark, rows)
    assert len(model.sums) == dims
    if dims == 2:
        assert model.n == 1 and [(r.whitened, r.deviation) for r in got] == [([], 0)] * 2
    elif not dims:
        assert not got


def test_deviations_are_exact_in_64_bits_and_null_beyond():
    x = np.array([[3, -7], [10**9, 5]])
    assert whitening.deviations(x, 2, [1, 2]) == [25 + 256, (2 * 10**9 - 1) ** 2 + 64]
    assert whitening.deviations(x, 10**6, [1, 2]) == [(3 * 10**6 - 1) ** 2 + (7 * 10**6 + 2) ** 2, None]


# ---- sharding


def check_shards(rows, got, shards, slack):
    """Every row once, slots without gaps, bytes equal up to `slack`."""
    key = lambda r: (r["record"]["doc_id"], r["record"]["text"])
    assert Counter(map(key, got)) == Counter(rows)
    places, load = defaultdict(list), [0] * shards
    for r in got:
        assert r["size"] == len((r["record"]["text"] or "").encode()) + 8
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load) - min(load) <= slack, load
    return load


def test_shards_of_documents(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for file_bytes in (128 << 20, 4000):
        monkeypatch.setattr(sharding, "FILE_BYTES", file_bytes)
        path = scratch_path(spark, "shards")
        got = sharding.shard(documents.repartition(3, "doc_id"), path, 7).collect()
        load = check_shards(rows, got, 7, 200)
        assert sum(load) == sum(len((t or "").encode()) + 8 for _, t in rows)
    files = [r.f for r in spark.read.parquet(f"{path}/records").select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) > 50


def test_shards_of_a_hot_record(spark):
    """A third of all rows is one record, which no hash can tell apart; another third has one text."""
    rows = [(1, "same " * 30)] * 3000 + [(10 + k, "one text " * 15) for k in range(3000)] + [(-k, f"t{k} " * (k % 50)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = scratch_path(spark, "hot")
    docs.write.parquet(path)
    got = sharding.shard(spark.read.parquet(path), scratch_path(spark, "shards"), 24).collect()
    load = check_shards(rows, got, 24, 0.2 * sum(len((t or "").encode()) + 8 for _, t in rows) / 24)
    assert min(load) > 0


@pytest.mark.parametrize("kind", ["odd", "nothing"])
def test_shards_of_odd_rows(spark, request, kind):
    docs = request.getfixturevalue(kind).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(-1))
    got = sharding.shard(docs, scratch_path(spark, "shards"), 3).collect()
    check_shards(ODD_TEXTS if kind == "odd" else [], got, 3, 10**9)
    assert all(r["record"]["shard"] == "mine" and r["record"]["toxic"] == "t" for r in got)


def loads(slot_map, total):
    found = [0.0] * slot_map.shards
    for slot, shards in enumerate(slot_map.entries):
        for s in shards:
            found[s] += total[slot] / len(shards)
    return found


def test_map_is_edited_and_kept_in_versions(spark):
    rng = np.random.default_rng(1)
    total = rng.integers(0, 1000, 512)
    total[5] = 400_000
    largest = np.minimum(total, 30)
    first = sharding.first_map(8, 512)
    even = sharding.rebalanced(first, total, largest)
    more = sharding.grown(even, total)
    assert max(loads(even, total)) - min(loads(even, total)) < 2 and len(even.entries[5]) > 8
    assert sum(a[0] == b[0] for a, b in zip(first.entries, even.entries, strict=True)) > 350  # the rest stays
    share = total.sum() / 9
    assert abs(loads(more, total)[8] - share) < 0.05 * share
    for a, b in zip(even.entries, more.entries, strict=True):
        assert all(x == y or y == 8 for x, y in zip(a, b, strict=True))
    path = scratch_path(spark, "map")
    for version in (first, even, more):
        sharding.save_map(spark, version, path)
    for version in (first, even, more):
        got = {r.slot: tuple(r.shards) for r in sharding.load_map(spark, path, version.version).collect()}
        assert got == dict(enumerate(version.entries))
    assert spark.read.parquet(path).where("version = 2").count() == len(more.edited) < 200


def test_shard_query(spark, sf):
    got = queries.op13_sharding(spark, sf).collect()
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert len(got) == len(rows)
    for r in got:
        data = (rows[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 24
