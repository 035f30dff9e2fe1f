"""From raw documents to packed training sequences, stage by stage.

Every stage takes what its predecessor kept, written as Parquet and read again. All but the
last return the columns of documents; extra columns go through untouched.

Defined cases: rows without a doc_id never leave in the near-duplicate stage; of rows that
repeat both id and text one stays; rows that repeat an id with different texts are judged each;
stages over an empty table give an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm import decontamination, packing, quality_rules, shingle_join, toxicity
from callsight.llm.batches import text_mark
from callsight.llm.common import kept, table
from callsight.llm.queries import TOXIC_CATEGORIES, label_table, tokenizer_file


def _wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns for an operator, and the whole row beside them, safe from it."""
    return docs.select(F.struct(*docs.columns).alias("__doc"), *names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = _wrapped(docs, "text", "lang")
    return quality_rules.judge(rows, quality_rules.references(rows)).where("kept").select("__doc.*")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last category of the chain, `toxic`, stays below the threshold."""
    labels = label_table(table(spark, sf_dir, "labels"))
    chain = toxicity.train(docs.select("doc_id", "text"), labels, TOXIC_CATEGORIES)
    return toxicity.score(_wrapped(docs, "text"), chain, TOXIC_CATEGORIES).where("not toxic").select("__doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked rows, the one with the smallest id, of several with that id the one
    whose text has the smallest mark; of rows that repeat id and text, the one whose other columns
    are smallest."""
    found = shingle_join.groups(docs.select("doc_id", "text")).where("doc_id is not null")
    stay = found.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select(
        F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark")
    )
    told = docs.withColumn("__mark", text_mark())
    leaves = found.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct().join(
        stay, ["__id", "__mark"], "left_anti"
    )
    same = (told["doc_id"] == leaves["__id"]) & (told["__mark"] == leaves["__mark"])
    kept_rows = told.join(leaves, same, "left_anti").drop("__mark")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept_rows.where("doc_id is not null").groupBy("doc_id", "text").agg(
        F.min(F.struct(*others) if others else F.lit(0)).alias("__rest")
    )
    whole = once.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__rest.{c}").alias(c) for c in docs.columns])
    return whole.unionByName(kept_rows.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    found = decontamination.find(_wrapped(docs), table(spark, sf_dir, "benchmark"), "__doc.text")
    return found.where("not contaminated").select("__doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their tokens and places in sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # classifiers, tokenizers and distances are beyond SQL; tests hold a plain version against it

QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
