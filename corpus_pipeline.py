"""The corpus pipeline: language ID, near-duplicates, decontamination, packing.

Each stage gets what the stage before it kept, written as Parquet and read again. All but
the last return the columns of their input as they are, whatever further columns there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajloom.llm import decontam, langid, neardup, packing
from trajloom.llm.common import store_by_batches
from trajloom.operators.store import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a language (null, or no letter) go, and ambiguous ones."""
    model = langid.learned(docs)
    rows = langid.predict(docs.select(F.struct("*").alias("doc"), docs["text"].alias("text")), model, ["doc"])
    return rows.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class of near-duplicates the document with the smallest id stays."""
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = store(decontam.find_leaks(docs.select("doc_id", "text"), benchmark), "leaks")
    return decontam.without_leaks(docs, leaks)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one row per piece of a sequence of at most 2048 tokens."""
    return packing.pack_table(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that every stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store_by_batches(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the stages (model, signatures, tokens); tests use brute force.
ORACLE_SQL: str | None = None
