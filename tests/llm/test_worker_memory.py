"""Tokens by runs of distinct words, and what a Python worker and kept tables hold on to."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from callsight.llm import common, packing
from callsight.llm.queries import tokenizer_file

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ODD = [
    "", " ", "  a  b ", "\x0b\x0cA's\x1c\x1dB#$ It's***", "foo'||x <|endoftext|> É#|#", "i̇ İ% ſ& ẞ*$ K& Å|", "Á#x ñ#̸ e#́", "|a| a|'s a#'s",
    "ÀÖØöø*|*|", "x;y#z", "\n\n\t", "Ως Σ", *(f"{a}{b}##" for a in LETTERS[26:] for b in LETTERS[20:40]),
]


@pytest.fixture(scope="module")
def tokens():
    return packing.WordTokens(tokenizer_file("word_bpe_49k.json"))


def test_odd_texts_have_the_tokenizers_ids(tokens):
    texts = [*ODD, " ".join(ODD)]
    assert list(tokens.encode([t.encode() for t in texts])) == tokens.ids(texts)


def test_marks_behind_letters_cost_no_call_of_their_own(tokens, monkeypatch):
    asked = []
    ids = tokens.ids
    monkeypatch.setattr(tokens, "ids", lambda texts: asked.extend(texts) or ids(texts))
    words = [f"quo{a}{b}{m}" for a in LETTERS for b in LETTERS for m in ("", "###", "&&&", "$$$.", "|")]
    text = " ".join(words)
    assert b"".join(tokens.encode([text.encode()])) == ids([text])[0]
    assert not [a for a in asked if re.search("[a-z]", a)]


def test_forgotten_words_are_found_again(tokens, monkeypatch):
    for most in (0, 1, 7):
        monkeypatch.setattr(tokens, "words", packing.Remembered(most))
        monkeypatch.setattr(tokens, "letters", packing.Remembered(most))
        for _ in range(3):
            for text in ("one two, three one", "two. four 77 two", "", "five one"):
                assert list(tokens.encode([text.encode()])) == tokens.ids([text])


def test_kept_rows_of_megabytes_lie_in_small_row_groups(spark):
    def noise(batches):
        rng = np.random.default_rng(1)
        for batch in batches:
            rows = [rng.bytes(1 << 20) for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["b"])

    rows = spark.range(0, 40, 1, 1).mapInArrow(noise, "b binary")
    files = common.kept(rows, "large").inputFiles()
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    assert meta.num_rows == 40
    assert meta.num_row_groups > 1


def test_a_task_releases_when_it_ends_or_stops(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    task = common.releasing(lambda batches: iter(batches))
    assert list(task([1, 2])) == [1, 2]
    assert done == [1]
    stopped = task([1, 2])
    next(stopped)
    stopped.close()
    assert done == [1, 1]
