"""From raw documents to packed training windows, in five stages.

Every stage reads what its predecessor kept and returns the columns of
``documents``; the last returns the places of all pieces.  No stage can be stated
in SQL as a whole (the first is a trained model), so ``ORACLE_SQL`` is None and the
tests hold the result against a brute-force version.

Defined cases: columns beyond those of ``documents`` go in the first stage; rows
without an id, repeated rows and ids are kept as the operators state it; of an empty
table nothing comes out.  A text that is null or holds no letter has no language and goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.language_id import UNKNOWN, with_language
from edgeloom.llm.line_dedup import dedup_lines
from edgeloom.llm.packing import pack_documents
from edgeloom.llm.parity_join import near_duplicates
from edgeloom.llm.runtime import intermediates, stored, table
from edgeloom.llm.surrogates import anonymized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without one (no letters) go. A missing lang is filled in."""
    found = with_language(docs.select(COLUMNS)).filter(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold go; so does a document that loses all it had."""
    out = dedup_lines(docs.select(COLUMNS)).withColumn("text", F.array_join("kept_lines", "\n"))
    return _counted(out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    kept = near_duplicates(docs).filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return _counted(anonymized(docs.select(COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows."""
    return pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``.

    A stage's intermediates and its input are deleted once it is written; what the
    last stage reads stays, as its result is read by the caller."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with intermediates(spark) as folders:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            written = folders.pop()
            folders += read
        read = [written]
    return STAGES[-1][1](spark, docs, sf_dir)
