"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates all pieces of the vocabulary that end at each character;
dynamic programming carries the best score and the number of pieces. Ties go as in the
tokenizer: a later start must be strictly better, so the longest piece wins; a character
that is no piece costs the smallest score less 10, and neighbours of that kind count as one.

Blanks become U+2581 and one is put in front. That is a piece itself, and none holds it after
another character, so a text falls apart before each run of them, and each distinct part is
solved once per worker. The scores are whole numbers, hence their sums are exact and a part's
best pieces do not depend on what stands before it; with other vocabularies a text is one part.

Defined cases: a null or empty text has 0 tokens and score 0; columns of the input with the
name of an added column are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import WordCache, worker_state

BLANK = "▁"
UNKNOWN_COST = 10.0
KEPT_PARTS = 600_000  # solved parts that a worker remembers; speed only
PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    """Pieces and score of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.apart = BLANK in self.automaton and all(BLANK not in p.lstrip(BLANK) and s == int(s) for p, s in pieces)
        self.parts = WordCache(self.solve, KEPT_PARTS)

    def solve(self, text: str) -> tuple[int, float]:
        """Tokens and score of one part.

        State at a position: best score, its tokens, whether the last one is unknown.
        """
        size = len(text)
        score, tokens, open_unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        ending: list[list[tuple[int, float]] | None] = [None] * size
        if not self.empty:
            for end, found in self.automaton.iter(text):
                if ending[end] is None:
                    ending[end] = [found]
                else:
                    ending[end].append(found)
        for end, found in enumerate(ending, 1):
            best, start, single = None, -1, False
            if found:
                if len(found) > 1:
                    found.sort(reverse=True)  # earliest start first
                single = found[-1][0] == 1
                for length, piece in found:
                    total = score[end - length] + piece
                    if best is None or total > best:
                        best, start = total, end - length
            known = True
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, start, known = total, end - 1, False
            score[end] = best
            tokens[end] = tokens[start] + (0 if not known and open_unknown[start] else 1)
            open_unknown[end] = not known
        return tokens[size], score[size]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = BLANK + text.replace(" ", BLANK)
        if not self.apart:
            return self.solve(text)
        tokens, total, parts = 0, 0.0, self.parts.fresh()
        for part in PARTS.findall(text):
            got = parts[part]
            tokens += got[0]
            total += got[1]
        return tokens, total


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens` and the segmentation's `token_score`.

    `model_file` is a path that every executor has; each Python worker loads it once.
    """

    @F.arrow_udf("struct<n_tokens:bigint,token_score:double>")
    def counts(texts: pa.Array) -> pa.Array:
        counter = worker_state(f"counter {model_file}", lambda: Counter(vocabulary(model_file)))
        rows = [counter.count(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())],
            ["n_tokens", "token_score"],
        )

    others = [c for c in docs.columns if c not in ("n_tokens", "token_score", "__count")]
    return docs.withColumn("__count", counts(F.col(text))).select(*others, "__count.n_tokens", "__count.token_score")
