import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from callsight.llm import decontamination, language_model, quality_rules, token_count, toxicity
from callsight.llm.common import table
from callsight.llm.queries import TOXIC_CATEGORIES, label_table, tokenizer_file
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import LONG, ODD_TEXTS

SPACE = re.compile("[^\x20\x09-\x0d]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- quality rules


def plain_counts(text):
    words = SPACE.findall(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            copies += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        copies,
        len(covered),
        failed,
    )


def plain_distance(p, q):
    keys = set(p) | set(q)
    total = 0.0
    for a, b in ((p, q), (q, p)):
        for k in keys:
            if a.get(k, 0) > 0:
                total += 0.5 * a[k] * math.log2(2 * a[k] / (a.get(k, 0) + b.get(k, 0)))
    return math.sqrt(max(0.0, total))


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()}


def plain_class(c):
    if c == "\n":
        return 4
    if c in " \t\r\x0b\x0c":
        return 3
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if "0" <= c <= "9":
        return 2
    if c in ",.;:!?'\"()-":
        return 5
    return 6 if ord(c) < 128 else 7


def plain_quality(rows):
    """doc_id -> (counts, class distance, word distance, kept)."""
    lang = {i: x if x and re.fullmatch("[a-z]{2,3}", x) else "und" for i, _, x in rows}
    classes, words = {}, {}
    numbered = lambda t: [zlib.crc32(w.translate(SMALL).encode()) % 4096 for w in SPACE.findall(t or "")]
    for i, text, _ in rows:
        classes.setdefault(lang[i], Counter()).update(map(plain_class, text or ""))
        words.setdefault(lang[i], Counter()).update(numbered(text))
    common = {x: {b for b, _ in sorted(n.items(), key=lambda e: (-e[1], e[0]))[:64]} for x, n in words.items()}
    folded = lambda n, x: Counter({k: v for k, v in n.items() if k in common[x]}) + Counter(
        {"rest": sum(v for k, v in n.items() if k not in common[x])}
    )
    out = {}
    for i, text, _ in rows:
        counts = plain_counts(text)
        far = None, None
        strange = False
        if counts[0] >= 10 and len(text) >= 40:
            x = lang[i]
            far = (
                plain_distance(shares(Counter(map(plain_class, text))), shares(classes[x])),
                plain_distance(shares(folded(Counter(numbered(text)), x)), shares(folded(words[x], x))),
            )
            most = max(0.27, 0.2 + 36 / len(text)), max(0.5, 0.38 + 1.2 / math.sqrt(counts[0]))
            strange = far[0] > most[0] or far[1] > most[1]
        out[i] = (*counts, *far, not counts[5] and not strange)
    return out


def test_quality_rules_match_the_plain_version(documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    plain = plain_quality(rows)
    got = quality_rules.rules(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[:6]
        assert r.class_distance == pytest.approx(want[6], abs=1e-9) and r.word_distance == pytest.approx(want[7], abs=1e-9)
        assert r.kept == want[8]
    assert 0 < sum(r.kept for r in got) < len(got)


def test_quality_rules_on_odd_rows(odd, nothing):
    got = quality_rules.rules(odd).collect()
    assert len(got) == len(ODD_TEXTS)
    for r in got:
        counts = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts
        assert r.kept in (True, False) and r.toxic == "t"
    assert quality_rules.rules(nothing).count() == 0


# ---- toxicity


def test_toxicity_on_held_out_documents(spark):
    """Trained on made-up documents with an even id, right on the others."""
    rng = random.Random(5)
    plain = ["".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(60, 400))
        low, bad = i % 5 == 0, i % 7 == 0
        words += (["spamword"] if low else []) + ([f"vile{rng.choice(plain)}" for _ in range(5)] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(low), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    labels = docs.where("doc_id % 2 = 0").drop("text")
    chain = toxicity.train(docs.select("doc_id", "text"), labels, TOXIC_CATEGORIES)
    assert [m.earlier.shape for m in chain] == [(0,), (1,)]
    got = toxicity.score(docs.select("doc_id", "text"), chain, TOXIC_CATEGORIES).where("doc_id % 2 = 1").collect()
    right = sum(r.toxic == (r.doc_id % 7 == 0) for r in got)
    assert len(got) == 450 and right >= 0.97 * len(got)


def test_toxicity_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 0, 1), (6, 0, 0), (9, 1, 1), (9, 0, None), (None, 1, 1), (77, 1, 1)],
        "doc_id long, low_quality int, toxic int",
    )
    for known in (labels, labels.where("false"), labels.withColumn("toxic", labels.toxic * 0)):
        chain = toxicity.train(odd, known, TOXIC_CATEGORIES)
        got = toxicity.score(odd, chain, TOXIC_CATEGORIES).collect()
        assert len(got) == len(ODD_TEXTS) and all(0 <= r.p_toxic <= 1 for r in got)
        same = {r.p_toxic for r in got if r.text == LONG}
        assert len(same) == 1
    assert toxicity.score(nothing, chain, TOXIC_CATEGORIES).count() == 0


# ---- token counts


def library_counts(pieces, texts):
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0), *pieces]
    scores = min(s for _, s in pieces)
    model = Tokenizer(models.Unigram([("<unk>", scores), *vocabulary[1:]], 0, False))
    return [len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in texts]


def test_token_counts_match_the_library(spark, documents, odd):
    pieces = token_count.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    rows = documents.union(odd.selectExpr("doc_id", "text", "lang", "lang", "doc_id")).select("doc_id", "text")
    got = token_count.count_tokens(rows, tokenizer_file("piece_bpe_32k.model")).collect()
    assert [r.n_tokens for r in got] == library_counts(pieces, [r.text or "" for r in got])


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.text("ab▁", min_size=1, max_size=4), st.integers(-6, 0)), min_size=1, max_size=8),
    st.text("abc ", max_size=24),
)
def test_token_count_ties(pieces, text):
    """Few scores, so that ties are frequent; pieces across blanks are solved as one part."""
    unique = list({p: (p, float(s)) for p, s in pieces}.values())
    counter = token_count.Counter(unique)
    assert counter.count(text)[0] == library_counts(unique, [text])[0]


def test_token_count_of_nothing(nothing):
    got = token_count.count_tokens(nothing, tokenizer_file("piece_bpe_32k.model"))
    assert got.count() == 0 and "n_tokens" in got.columns


# ---- language model


def plain_model(rows):
    """(doc_id, held out, tokens, known, N, base score, score) of every row; orders 1 and 2."""
    texts = [(i, [*SPACE.findall((t or "").translate(SMALL)), "\0end"]) for i, t in rows]
    name = lambda i: ("" if i is None else str(i)).encode()
    held = lambda i: zlib.crc32(name(i)) % 10 == 0
    grams = lambda words: list(zip(["\0begin", *words], words, strict=False))
    training = [(i, words) for i, words in texts if not held(i)]
    one = Counter(w for _, words in training for w in words)
    two = Counter(g for _, words in training for g in grams(words))

    def events(words, itself=False):
        """Base estimate, ratio and bucket of each token; `itself`: the text is taken out of the counts first."""
        own_one, own_two = (Counter(words), Counter(grams(words))) if itself else (Counter(), Counter())
        n, docs = sum(one.values()) - own_one.total(), len(training) - itself
        v = len(one) - sum(one[w] == own_one[w] for w in own_one)
        for before, word in grams(words):
            context = docs if before == "\0begin" else one[before] - own_one[before]
            ratio = (two[before, word] - own_two[before, word]) / context if context else 0.0
            yield (one[word] - own_one[word] + 0.1) / (n + 0.1 * (v + 1)), ratio, min(context.bit_length(), 23)

    learning = [words for i, words in training if xxhash.xxh3_64_intdigest(name(i)) % 10 == 0]
    found = [e for words in learning or [words for _, words in training] for e in events(words, True)]
    weights = [0.0] + [0.5] * 23
    for _ in range(12):
        used, seen = [0.0] * 24, [0] * 24
        for base, ratio, k in found:
            used[k] += weights[k] * ratio / (weights[k] * ratio + (1 - weights[k]) * base)
            seen[k] += 1
        weights = [0.0] + [used[k] / seen[k] if seen[k] else weights[k] for k in range(1, 24)]
    out = []
    for i, words in texts:
        own = list(events(words))
        base = sum(math.log10(b) for b, _, _ in own)
        score = sum(math.log10(weights[k] * r + (1 - weights[k]) * b) for b, r, k in own)
        out.append((i, held(i), len(words), sum(one[w] > 0 for w in words), sum(one.values()), base, score))
    return out


def check_model(docs):
    by = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(plain_model([(r.doc_id, r.text) for r in docs.collect()]), key=by)
    got = sorted(map(tuple, language_model.score(docs).collect()), key=by)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)
    return got


def test_language_model_matches_the_plain_version(documents):
    got = check_model(documents)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_language_model_on_odd_rows(odd, nothing):
    check_model(odd)
    assert language_model.score(nothing).count() == 0


def test_language_model_with_more_orders(documents):
    """Three orders fit held-out documents no worse than two, one is the base itself."""
    by = {k: language_model.score(documents, order=k).where("held_out").selectExpr("sum(score)", "sum(base_score)").first() for k in (1, 2, 3)}
    assert by[1][0] == pytest.approx(by[1][1]) and by[3][0] > by[2][0] - 0.01 * abs(by[2][0])


# ---- decontamination


def plain_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(SMALL))
    words, hit, found = find(text), set(), set()
    for item, body in items:
        own = find(body)
        for k in range(max(1, len(own) - 12) if own else 0):
            window = own[k : k + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def check_hits(docs, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = decontamination.find(docs, benchmark).collect()
    hits = 0
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == plain_hits(r.text, items)
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and r.n_items == len(r["items"])
        hits += r.n_hit > 0
    return len(got), hits


def test_decontamination_matches_the_plain_version(spark, documents, sf, monkeypatch):
    benchmark = table(spark, sf, "benchmark")
    some = documents.limit(60).union(
        benchmark.selectExpr("item_id + 1000", "concat('Before it ', text, ' and after')", "'en'", "'s'", "0L")
    )
    total, hits = check_hits(some, benchmark)
    assert hits >= benchmark.count() and hits < total
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1500)  # several passes
    assert check_hits(some, benchmark) == (total, hits)


def test_decontamination_on_odd_rows(spark, odd, nothing):
    benchmark = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one"), (4, "ONE, two!"), (4, "b c d e f g h i j k l m n o"), (None, "東京 😀"), (5, "x y"), (5, "z")],
        "item_id long, text string",
    )
    total, hits = check_hits(odd.where("n_words = 'n' and (doc_id is null or doc_id not in (6, 7))"), benchmark)
    assert total == len(ODD_TEXTS) - 2 and hits >= 5
    assert decontamination.find(odd, benchmark.where("false")).where("contaminated").count() == 0
    assert decontamination.find(nothing, benchmark).count() == 0


def test_decontamination_of_a_very_long_text(spark, odd):
    words = LONG.split()
    benchmark = spark.createDataFrame([(1, " ".join(words[500:520])), (2, " ".join(words[-13:]))], "item_id long, text string")
    rows = decontamination.find(odd.where("doc_id in (6, 7)"), benchmark).collect()
    assert [r["items"] for r in rows] == [["1", "2"]] * 2 and rows[0].spans == rows[1].spans


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=6),
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=18), max_size=5),
)
def test_index_of_few_words(texts, items):
    """Texts of three words, so that nearly all suffixes tie for long."""
    phrases = decontamination.Phrases([(str(k), b" ".join(i)) for k, i in enumerate(items)])
    got = decontamination.search_texts([b" ".join(t) for t in texts], phrases)
    plain = [(str(k), b" ".join(i).decode()) for k, i in enumerate(items)]
    for text, (n, spans, found) in zip(texts, got, strict=True):
        want = plain_hits(b" ".join(text).decode(), plain)
        assert (n, sum(b - a for a, b in spans), found) == want[:3]
