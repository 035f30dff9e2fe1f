"""Weights, key classes and totals of the language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from callsight.llm import batches, language_model

from .test_text_operators import SMALL, SPACE

BEGIN = "\0begin"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def plain_scores(rows, learn):
    """doc_id -> (base score, score); orders 1 and 2, weights from the documents of `learn` without themselves."""
    texts = {i: [*SPACE.findall((t or "").translate(SMALL)), "\0end"] for i, t in rows}
    grams = lambda words: list(zip([BEGIN, *words], words, strict=False))
    training = [i for i in texts if not held(i)]

    def events(i, left_out=None):
        counted = [j for j in training if j != left_out]
        one = Counter(w for j in counted for w in texts[j])
        two = Counter(g for j in counted for g in grams(texts[j]))
        n, v = sum(one.values()), len(one)
        for before, word in grams(texts[i]):
            context = len(counted) if before == BEGIN else one[before]
            yield (one[word] + 0.1) / (n + 0.1 * (v + 1)), two[before, word] / context if context else 0.0, min(context.bit_length(), 23)

    learning = [e for i in learn for e in events(i, i)]
    weights = [0.0] + [0.5] * 23
    for _ in range(12):
        used, seen = [0.0] * 24, [0] * 24
        for base, ratio, k in learning:
            used[k] += weights[k] * ratio / (weights[k] * ratio + (1 - weights[k]) * base)
            seen[k] += 1
        weights = [0.0] + [used[k] / seen[k] if seen[k] else weights[k] for k in range(1, 24)]
    return {
        i: (
            sum(math.log10(b) for b, _, _ in events(i)),
            sum(math.log10(weights[k] * r + (1 - weights[k]) * b) for b, r, k in events(i)),
        )
        for i in texts
    }


def weighted(rows, big, learn):
    """Scores of `rows` by the plain version, the counts of the many equal documents `big` put in by number."""
    words = [*big[0][1].split(), "\0end"]
    pairs = Counter(zip([BEGIN, *words], words, strict=False))
    texts = {i: [*SPACE.findall((t or "").translate(SMALL)), "\0end"] for i, t in rows}
    grams = lambda w: list(zip([BEGIN, *w], w, strict=False))
    training = [i for i in texts if not held(i)]
    one, two = Counter(w for i in training for w in texts[i]), Counter(g for i in training for g in grams(texts[i]))
    for w, k in Counter(words).items():
        one[w] += k * len(big)
    for g, k in pairs.items():
        two[g] += k * len(big)
    docs = len(training) + len(big)

    def events(i, itself):
        a, b = (Counter(texts[i]), Counter(grams(texts[i]))) if itself else (Counter(), Counter())
        n, v = one.total() - a.total(), len(one) - sum(one[w] == a[w] for w in a)
        for before, word in grams(texts[i]):
            context = docs - itself if before == BEGIN else one[before] - a[before]
            ratio = (two[before, word] - b[before, word]) / context if context else 0.0
            yield (one[word] - a[word] + 0.1) / (n + 0.1 * (v + 1)), ratio, min(context.bit_length(), 23)

    learning = [e for i in learn for e in events(i, True)]
    weights = [0.0] + [0.5] * 23
    for _ in range(12):
        used, seen = [0.0] * 24, [0] * 24
        for base, ratio, k in learning:
            used[k] += weights[k] * ratio / (weights[k] * ratio + (1 - weights[k]) * base)
            seen[k] += 1
        weights = [0.0] + [used[k] / seen[k] if seen[k] else weights[k] for k in range(1, 24)]
    return {i: sum(math.log10(weights[k] * r + (1 - weights[k]) * b) for b, r, k in events(i, False)) for i in texts}


def scores(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.base_score, r.score) for r in language_model.score(docs).collect()}


@pytest.fixture(scope="module")
def rows(documents):
    found = [(r.doc_id, r.text[:600]) for r in documents.orderBy("doc_id").limit(50).collect()]
    return [*found, (1000, ""), (1001, "only here only here"), (1002, found[0][1])]


@pytest.mark.parametrize("fold", [language_model.LEARNING, None])
def test_weights_are_learned_inside_the_training_part(spark, rows, fold):
    """By a tenth of the training documents; by all of them only where that tenth is empty."""
    if fold is None:
        rows = [r for r in rows if language_model.part_of(r[0]) != language_model.LEARNING]
    learn = [i for i, _ in rows if not held(i) and fold in (None, language_model.part_of(i))]
    assert 0 < len(learn) < len(rows)
    got, want = scores(spark, rows), plain_scores(rows, learn)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == (pytest.approx(want[i][0], rel=1e-9), pytest.approx(want[i][1], rel=1e-5))


def test_the_rule_is_the_same_above_a_million_tokens(spark, rows):
    """More documents that say nothing new to the learning ones leave their choice as it is."""
    extra = [i for i in range(10_000, 10_400) if language_model.part_of(i) == language_model.COUNTED]
    big = [(i, "plain words again " * 1200) for i in extra]
    learn = [i for i, _ in rows if language_model.part_of(i) == language_model.LEARNING]
    assert sum(3601 for _ in big) > 1_000_000 and learn
    got, want = scores(spark, [*rows, *big]), weighted(rows, big, learn)
    for i in want:
        assert got[i][1] == pytest.approx(want[i], rel=1e-5)


def test_held_out_documents_have_no_share_in_any_score(spark, rows):
    training = [r for r in rows if not held(r[0])]
    alone = scores(spark, training)
    beside = scores(spark, training + [(i, "quite another text of other words") for i, _ in rows if held(i)])
    whole = scores(spark, rows)
    for i, _ in training:
        assert alone[i] == pytest.approx(beside[i], rel=1e-9) and alone[i] == pytest.approx(whole[i], rel=1e-9)


def test_base_scores_are_the_same_for_any_order(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, five = ({r.doc_id: r.base_score for r in language_model.score(docs, order=k).collect()} for k in (1, 5))
    assert five == pytest.approx(one, rel=1e-9)


def test_totals_above_32_bits_are_exact(spark):
    rows = spark.createDataFrame([(0,), (1,)], "batch long")
    keys = np.array([5, 9], np.uint64)
    totals = batches.total_counts(rows, lambda row: (keys, np.array([3_000_000_001, 1])), 4)
    got = [batches.totals_of(r.asDict()).tolist() for r in totals.where("batch >= 0").selectExpr("array(struct(totals)) as answers").collect()]
    assert got == [[6_000_000_002, 2]] * 2
