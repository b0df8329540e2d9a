"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), ``docs`` being all that the stage before
kept, and returns rows with the columns of ``documents``; the last returns the
pieces of packed sequences. Models are learned from the tables of ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import language_id, packing, quality, simhash, suffix_dedup
from chronolens.llm.common import small_batches, table, tokenizer_path, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (operator 10)."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.kept(docs, quality.learn(table(spark, sf_dir, "documents"), labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or between two, go (operator 9)."""
    known = table(spark, sf_dir, "documents").where(~language_id.held_out(F.col("doc_id")))
    return language_id.kept(docs, language_id.learn(known))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 3)."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated strings are cut; documents with nothing left go (operator 2)."""
    small_batches(spark)
    out = suffix_dedup.deduplicated(docs).where("text <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of related documents (operator 1)."""
    small_batches(spark)
    return packing.packed_pieces(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("repeated strings", repeat_stage),
    ("packing", packing_stage),
]

#: No SQL for the stages' models, fingerprints and tokenizer; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
