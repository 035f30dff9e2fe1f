import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from callsight.llm import html_text, packing, shingle_join, url_filter, warc
from callsight.llm.common import table
from callsight.llm.components import components
from callsight.llm.queries import URL_RULES, tokenizer_file
from callsight.session import scratch_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .conftest import LONG, ODD_TEXTS

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- URL filter


URLS = [
    None,
    "",
    "no scheme",
    "http://WWW.Example.org/es/1?b=2&a=1&utm_source=x#top",
    "https://a.example.org/en/1",
    "https://a.example.org/en/2/",
    "http://example.com/de/x",
    "http://example.com/fr/x",
    "http://com/de/",
    "http://notcom/de/",
    "http://x.net",
    "http://x.net/",
    "https://www.x.net?ref=1",
    "http://x.net/a?q=1&p=2#f",
    "http://x.net/a?p=2&q=1",
    "a\nb://x.net/a?p=2&q=1",
    "http://user:pw@X.net:80/Ä/%20",
    "http://x.net/" + "long/" * 20_000,
    "a?b#c://x.net/a?p=2&q=1",
    "mailto:x#y://Q.net/z/?utm_source=l#://w",
]


def plain_canonical(url):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = host.translate(SMALL)
    host = host[4:] if host.startswith("www.") else host
    kept = sorted(p for p in query.split("&") if p and not re.match(url_filter.TRACKING, p))
    return host + (slash + path).rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_verdict(url, listed):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(SMALL)
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        best = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]
    return host, path, None, "block" if plain_canonical(url) in listed - {None} else "allow"


def test_url_filter_on_odd_urls(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")
    entries = [None, "x.net/a?p=2&q=1", "x.net/a?p=2&q=1", "x.net", "a.example.org/en/2"]
    for listed in (entries, []):
        rows = spark.createDataFrame([(e,) for e in listed], "entry string")
        got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES, rows).collect()}
        assert len(got) == 2 * len(URLS)
        for k, url in enumerate([*URLS, *URLS]):
            assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == plain_verdict(url, set(listed))
            assert got[k].canonical == plain_canonical(url)
    assert url_filter.judge(pages.where("false"), URL_RULES, rows).count() == 0


def test_the_join_decides_and_not_the_host(spark, sf):
    """The list is written otherwise than the pages: canonical forms find it, and other URLs of a listed host pass."""
    from callsight.llm import queries

    rows = queries.op2_url_filter(spark, sf).collect()
    listed = [r for r in rows if r.listed]
    hosts = {r.host for r in listed}
    assert listed and any(r.verdict == "block" and r.rule is None for r in listed)
    assert any(r.host in hosts and not r.listed and r.verdict == "allow" for r in rows)
    urls = table(spark, sf, "pages").select(F.col("url"), queries.seen_elsewhere(F.col("url")).alias("other"))
    both = urls.select("url", "other", url_filter.canonical(F.col("url")).alias("a"), url_filter.canonical(F.col("other")).alias("b")).collect()
    assert all(r.a == r.b == plain_canonical(r.url) for r in both) and all(r.url != r.other for r in both if r.url)
    empty = url_filter.judge(table(spark, sf, "pages"), URL_RULES, spark.createDataFrame([], "entry string")).collect()
    assert {r.page_id for r in empty if r.verdict == "block"} < {r.page_id for r in rows if r.verdict == "block"}


def test_url_filter_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a", 9, 9, "m", 9), (None, None, 9, 9, "m", 9)], "page_id long, url string, host int, listed int, maybe string, entry int")
    got = url_filter.judge(pages, URL_RULES, spark.createDataFrame([("x.net/a",)], "canonical string")).collect()
    assert {(r.page_id, r.host, r.listed, r.verdict) for r in got} == {(1, "x.net", True, "block"), (None, "", False, "allow")}


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.BlockedBloom(keys)
    tested = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn(
        "maybe", bloom.may_hold(F.col("key"))
    )
    row = tested.agg(
        F.expr("count_if(maybe and id < 20000)").alias("held"), F.expr("count_if(maybe and id >= 20000)").alias("false_hits")
    ).first()
    assert row.held == 20_000 and row.false_hits < 0.02 * 40_000


# ---- WARC


def plain_types(rows):
    first = {}
    for page_id, payload in rows:
        if len(payload) >= 100 and page_id is not None:
            first[payload] = min(first.get(payload, page_id), page_id)
    out = []
    for page_id, payload in rows:
        of = first.get(payload)
        revisit = of is not None and page_id is not None and page_id > of
        digest = hashlib.sha256(payload).hexdigest()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", of if revisit else None))
    return out


HTML = ["<p>" + "tall story " * 20, "short", None, "", "ñ" * 60, "<p>" + "other " * 5000, "\x1f \x00 gzip"]


def test_warc_round_trip_at_any_split(spark):
    random.seed(3)
    rows = [(k, f"http://x.net/{k}\r\n" if k % 3 else None, random.choice(HTML)) for k in range(300)]
    rows += [(5, "u", HTML[0]), (None, "v", HTML[0]), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write(pages, scratch_path(spark, "warc"), archive_bytes=6000)
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == len(rows)
    by = lambda r: (r[0] is None, r[0] or 0, r[1:3])
    want = sorted(plain_types([(i, (h or "").encode()) for i, _, h in rows]), key=by)
    for split in (97, 1000, 1 << 20):
        got = warc.read(spark, files, split).collect()
        short = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
        assert sorted(short, key=by) == want
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_warc_paths(spark):
    """A path without a file system is the cluster's own, and the names that Hadoop and Arrow use differ for S3."""
    pages = spark.createDataFrame([(1, "u", HTML[0], "mine", 7)], "page_id long, url string, html string, path string, offset int")
    folder = scratch_path(spark, "warc").removeprefix("file://")
    files = warc.write(pages, folder)
    path = files.first().path
    assert folder.startswith("/") and path.startswith("file:/") and warc.qualified(spark, folder).startswith("file:/")
    assert warc.read(spark, files).first().page_id == 1
    bare = spark.createDataFrame([("/" + path.partition(":")[2].lstrip("/"), files.first().bytes)], "path string, bytes long")
    assert warc.read(spark, bare).first().page_id == 1
    assert type(warc._filesystem("s3a://bucket/a?region=eu-west-1")[0]).__name__ == "S3FileSystem"
    with pytest.raises(Exception, match="(?i)unrecognized"):
        warc._filesystem("nowhere://a/b")


def test_reader_lets_go_of_what_it_has_read(tmp_path):
    """Members larger and smaller than a read, with and without junk between them."""
    random.seed(2)
    parts, want = [], []
    for k in range(60):
        body = random.randbytes(random.choice([10, 5_000, 300_000, 2_500_000 if k % 20 == 0 else 100]))
        parts += [gzip.compress(warc.record(k, "u", body, "d", None), 1), random.choice([b"", b"\x1f\x8b\x08"])]
        want.append((f"<urn:page:{k}>", len(body)))
    path = tmp_path / "x.gz"
    path.write_bytes(b"".join(parts))
    with path.open("rb") as file:
        got = [(f["warc-record-id"], len(b.partition(b"\r\n\r\n")[2])) for _, f, b in warc.records_of(file, 0, path.stat().st_size)]
    assert got == want


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(pages, scratch_path(spark, "warc"))).count() == 0


def test_reader_passes_false_magic(tmp_path):
    """Members that only look like records are passed over."""
    one = warc.record(1, "u", b"a" * 300, "d", None)
    fake = gzip.compress(b"WARC/1.1 but no header")
    data = gzip.compress(one) + b"\x1f\x8b\x08\x00junk" + fake + gzip.compress(one.replace(b":1>", b":2>"))
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    for cut in range(0, len(data), 7):
        found = []
        for start, end in ((0, cut), (cut, len(data))):
            with path.open("rb") as file:
                found += [f["warc-record-id"] for _, f, _ in warc.records_of(file, start, end)]
        assert found == ["<urn:page:1>", "<urn:page:2>"]


# ---- main text


PAGES = [
    ("<nav><a href=/>home</a></nav><article><h1>Title</h1><p>A  few\n words &amp; more.</p></article>", "Title A few words & more."),
    ("<header><p>The site</p></header><main><p>One.<p>Two.</main><footer>&copy; us</footer>", "One. Two."),
    ("<article><p>Yes.</p><div class='ad'>Buy</div><p>No.</p></article><section id=comments><p>Reader says</p></section>", "Yes. No."),
    ("<article><p>Un<b>brok</b>en<script>var a='</p>';</script> text</article><style>p{}</style>", "Unbroken text"),
    ("<article><p>Cut of", "Cut of"),
    ("<article><p>Cut <a href='x", "Cut"),
    ("<article><!-- <p>no</p> --><p>a &lt;b&gt; &eacute; &#x41;</p></article><aside><p>side</p></aside>", "a <b> é A"),
    ("<form><p>Tell us who you are</p></form><div class='cookie-notice'>We use</div><article><ul><li>x<li>y</ul></article>", "x y"),
    ("", ""),
    (None, ""),
    ("<p>" + "many words here " * 30_000 + "</p>", ("many words here " * 30_000).strip()),
]


def test_main_text(spark):
    rows = [(k, "u", h, "old") for k, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html_text.extract(pages.where("false")).count() == 0


def test_main_text_of_the_test_pages(spark, sf):
    """Of these pages everything inside the article is main text."""
    import html

    for r in html_text.extract(table(spark, sf, "pages")).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r.text == " ".join(html.unescape(plain).split())


@settings(max_examples=300, deadline=None)
@given(st.text("<>/!-&;=\"' \nabpé", max_size=80))
def test_any_text_is_a_page(page):
    html_text.main_text(page, TREE)


TREE = html_text.trained()


def test_tree_learns_its_table():
    for page in html_text.LABELLED:
        found = html_text.blocks(page)
        assert html_text.predict(TREE, html_text.features(found)).tolist() == [b.text.startswith(html_text.MARK) for b in found]


# ---- packing


def check_packing(docs, got):
    """Tokens as the tokenizer gives them, sequences without gaps and within capacity."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        if r.ids is not None:
            assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by), sum(r.length for r in got)


def test_packing_of_documents(documents):
    got = packing.pack(documents, tokenizer_file("word_bpe_49k.json")).collect()
    bins, tokens = check_packing([(r.doc_id, r.text) for r in documents.collect()], got)
    assert bins <= -(-tokens // 4096) + 1


def test_packing_on_odd_rows(odd, nothing):
    got = packing.pack(odd, tokenizer_file("word_bpe_49k.json")).collect()
    bins, tokens = check_packing(ODD_TEXTS, got)
    assert bins <= -(-tokens // 4096) + 1
    assert packing.pack(nothing, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_packing_by_several_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    rng = random.Random(1)
    lengths = [(k, rng.choice([rng.randint(1, 4095), 4096, 1365, 2048])) for k in range(500)]
    rows = spark.createDataFrame(lengths, "uid long, length long")
    got = rows.join(packing.place(rows), "uid").collect()
    assert len(got) == 500
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(p)[-1][0] + sorted(p)[-1][1] == sum(x for _, x in p) <= 4096 for p in by.values())
    whole = packing.best_fit([], sorted(range(500), key=lambda k: -lengths[k][1]), [n for _, n in lengths], 4096)
    assert len(by) <= 1.02 * len(whole) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(0, 99))
def test_children_hold_every_item_once(lengths, seed):
    rng = random.Random(seed)
    packings = packing.first_packings(lengths, 100, rng)
    ranked = packing.evolve(packings, lengths, 100, rng)
    for p in ranked:
        assert sorted(i for b in p for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 100 for b in p)
    assert len(ranked[0]) <= min(map(len, packings))


# ---- near copies


def plain_groups(rows, least=85):
    """(doc_id, shingles, group) of rows (doc_id, text); rows are told apart by place."""
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(SMALL))
        sets.append({tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(k)] = min(smallest.get(root(k), doc_id), doc_id)
    return [
        (i, len(s), i if not s else smallest.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))
    ]


def near_copies(seed, families, size):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        words = [rng.choice(["alpha", "beta", "gamma", f"w{f}_{rng.randint(0, 60)}"]) for _ in range(rng.randint(4, 70))]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 30)}"
            rows.append((len(rows) * 3 % 1009, " ".join(copy)))
    return rows


def check_groups(spark, rows):
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, component_id int")
    by = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, shingle_join.join(docs).collect()), key=by) == sorted(plain_groups(rows), key=by)


def test_shingle_join_matches_all_pairs(spark, monkeypatch):
    rows = near_copies(2, 12, 25)
    check_groups(spark, rows)
    monkeypatch.setattr(shingle_join, "BLOCK", 4)  # clusters cut into blocks
    monkeypatch.setattr("callsight.llm.batches.BATCH_WORDS", 300)
    monkeypatch.setattr("callsight.llm.batches.BUCKET_KEYS", 700)
    check_groups(spark, rows)


def test_shingle_join_on_odd_rows(spark, odd, nothing):
    check_groups(spark, [(i, t) for i, t in ODD_TEXTS if t != LONG])
    got = {r.doc_id: r.component_id for r in shingle_join.join(odd.where("doc_id in (6, 7)")).collect()}
    assert got == {6: 6, 7: 6}
    assert shingle_join.join(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1), min_size=2, max_size=14, unique=True), st.sampled_from([30, 50, 85]))
def test_trie_finds_all_links(sets, least):
    groups = shingle_join.grouped([np.array(sorted(s), np.uint64) for s in sets], least)
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if p == old else p for p in parent]
    assert groups.tolist() == parent


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}


# ---- pipeline


@pytest.mark.parametrize("kind", ["documents", "odd", "nothing"])
def test_pipeline_stages(spark, sf, request, kind):
    import corpus_pipeline
    from callsight.llm.common import kept

    from .test_text_operators import plain_hits, plain_quality

    docs = request.getfixturevalue(kind)
    benchmark = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        after = kept(stage(spark, docs, sf), "stage")
        got = after.collect()
        key = lambda r: (r.doc_id, r.text)
        if name != "best-fit packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            assert not Counter(map(tuple, got)) - Counter(map(tuple, rows))
        left = Counter(map(key, got)) if name != "best-fit packing" else None
        if name == "quality rules" and kind == "documents":
            plain = plain_quality([(r.doc_id, r.text, r.lang) for r in rows])
            assert left == Counter(key(r) for r in rows if plain[r.doc_id][8])
        if name == "n-gram Jaccard join":
            groups = plain_groups([(r.doc_id, r.text) for r in rows if r.text != LONG])
            stay = {i for i, _, g in groups if i == g or i is None}
            assert {i for i, t in left if t != LONG} == stay and sum(t == LONG for _, t in left) <= 1
        if name == "benchmark decontamination":
            assert left == Counter(key(r) for r in rows if r.text == LONG or not plain_hits(r.text, benchmark)[3])
        if name == "best-fit packing":
            check_packing([(r.doc_id, r.text) for r in rows], got)
        docs = after
