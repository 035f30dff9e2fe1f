"""Junk that the quality rules have to tell by its distance, whatever its length."""

import random

import pytest
from callsight.llm import quality_rules

WORDS = "the river rose after a storm and old bridge near mill was closed for week while workers cleared it slowly by hand".split()


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def junk(seed, n):
    """Prose in which every third word is a run of symbols."""
    return " ".join("%&#@"[k % 4] * 4 if k % 3 == 0 else w for k, w in enumerate(prose(seed, n).split()))


def judged(spark, odd_ones, good_length):
    rows = [(k, prose(k, good_length), "en") for k in range(200)] + [(1000 + k, t, "en") for k, t in enumerate(odd_ones)]
    got = quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.kept for r in got if r.doc_id < 1000 and not r.base_failed)
    return [r for r in got if r.doc_id >= 1000 and not r.base_failed]


def test_symbol_junk_is_dropped(spark):
    found = judged(spark, [junk(k, 300) for k in range(20)], 300)
    assert found and all(0.27 < r.class_distance < 0.35 and r.word_distance < 0.5 for r in found)
    assert not any(r.kept for r in found)


@pytest.mark.parametrize("n", [60, 90])
def test_short_junk_is_dropped(spark, n):
    found = judged(spark, [junk(k, n) for k in range(20)], 300)
    assert found and not any(r.kept for r in found)


def test_short_prose_stays_and_a_few_dozen_characters_are_not_compared(spark):
    rows = [(k, prose(k, 11 + k), "en") for k in range(80)] + [(1000, "a b c d e f g h i j k", "en"), (1001, "& % # @ ! = + ~ ^ _", "en")]
    got = {r.doc_id: r for r in quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].class_distance is not None and (got[k].kept or got[k].base_failed) for k in range(80))
    assert all(got[k].class_distance is None and got[k].kept for k in (1000, 1001))
