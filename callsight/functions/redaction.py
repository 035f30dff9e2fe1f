"""Scrubbing of personal data from short texts.

Two layers with their own rules: the client's light pass and the worker's strong
pass. Both are chains of built-in `regexp_replace`, so they stay in the JVM; an
outside engine can be plugged in as an Arrow-batched function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, tokens, and the order in which they are applied.
EMAIL = (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]")
SSN = (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]")
CARD = (r"\b(?:\d[ -]*?){13,16}\b", "[CARD]")
IP = (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]")
PHONE = (r"\b(?:\+?\d[\d\s().-]{7,}\d)\b", "[PHONE]")
CLIENT_RULES = (EMAIL, CARD, PHONE)
ENGINE_ROWS = 500  # texts that an outside engine gets at once: of an Arrow batch, a part alone is held twice
WORKER_RULES = (EMAIL, SSN, CARD, IP, PHONE)

# Java's classes are ASCII-only without this flag.
UNICODE_CLASSES = "(?U)"


def scrub(text: Column, rules: tuple[tuple[str, str], ...] = WORKER_RULES) -> Column:
    """The rules in order. An address needs an at sign and every other rule a digit, and no
    token brings one in: texts without them, as most are, skip the costly patterns."""
    clean = text
    for needs, group in groupby(rules, key=lambda rule: rule == EMAIL):
        after = clean
        for pattern, token in group:
            after = F.regexp_replace(after, UNICODE_CLASSES + pattern, token)
        possible = F.contains(text, F.lit("@")) if needs else F.rlike(text, F.lit(UNICODE_CLASSES + r"\d"))
        clean = F.when(possible, after).otherwise(clean)
    return clean


class Engine(Protocol):
    """An outside engine: scrubs a batch of texts, none of them null. A text counts as
    changed if it comes back different."""

    def redact(self, texts: pd.Series) -> pd.Series: ...


def by_rules(rules: tuple[tuple[str, str], ...] = WORKER_RULES) -> Callable[[Column], Column]:
    """Column -> struct<text, changed>. A token never equals what it replaces, so a
    text changed exactly when some rule matched."""

    def apply(text: Column) -> Column:
        clean = scrub(text, rules)
        return F.struct(clean.alias("text"), F.coalesce(clean != text, F.lit(False)).alias("changed"))

    return apply


def by_nothing() -> Callable[[Column], Column]:
    return lambda text: F.struct(text.alias("text"), F.lit(False).alias("changed"))


def by_engine(factory: Callable[[], Engine]) -> Callable[[Column], Column]:
    """Column -> struct<text, changed> through an outside engine, built once per worker."""

    @F.pandas_udf("text string, changed boolean")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for batch in batches:
            for at in range(0, len(batch), ENGINE_ROWS):
                texts = batch.iloc[at : at + ENGINE_ROWS]
                clean = texts.copy()
                filled = texts.notna() & (texts != "")
                clean[filled] = engine.redact(texts[filled])
                yield pd.DataFrame({"text": clean, "changed": filled & (clean != texts)})

    return apply


# What a configured name stands for, besides the engines that a caller brings along.
REDACTORS: Mapping[str, Callable[[], Callable[[Column], Column]]] = {"none": by_nothing, "regex": by_rules}


def choose(
    name: str = "regex", engines: Mapping[str, Callable[[], Engine]] | None = None
) -> Callable[[Column], Column]:
    """The redactor for a configured name in any letter case: one of `engines` (name ->
    factory), nothing, or the rules, which also stand in for names that nobody knows."""
    brought = {key.lower(): factory for key, factory in (engines or {}).items()}
    if name.lower() in brought:
        return by_engine(brought[name.lower()])
    return REDACTORS.get(name.lower(), by_rules)()


def redact_events(df: DataFrame, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """Scrub both previews and raise `redacted`; ids and times stay as they are."""
    redactor = redactor or by_rules()
    found = df.withColumns(
        {"_in": redactor(F.col("input_preview")), "_out": redactor(F.col("output_preview"))}
    )
    changed = F.coalesce(F.col("_in.changed") | F.col("_out.changed"), F.lit(False))
    flag = df.schema["redacted"].dataType
    return found.withColumns(
        {
            "input_preview": F.col("_in.text"),
            "output_preview": F.col("_out.text"),
            "redacted": (F.col("redacted").cast("boolean") | changed).cast(flag),
        }
    ).drop("_in", "_out")
