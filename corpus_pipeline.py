"""Corpus pipeline: language ID, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and all but the last
return these columns. `run` writes a stage's rows to the shared folder and reads them again for the next, then removes what the stage has read there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifgrid.llm import language, minhash, packing, pii, quality
from motifgrid.llm.common import fresh, removed, written

#: Documents whose language is less sure than this go.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a sure language, go."""
    learned = language.train(docs.filter(~language.held_out(docs)).select("lang", "text"))
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    named = language.identified(docs, learned, docs.columns, lang, score)
    return named.filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much; n_chars follows the text."""
    names = docs.columns
    return quality.cleaned(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the first of the table, so a repeated doc_id doesn't matter.

    Rows are numbered once, in a written table that all steps read: how docs is split when it is read again changes nothing.
    """
    row = fresh(docs.columns, "row")
    placed = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    kept = minhash.near_duplicates(placed.select(F.col(row).alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias(row))
    return placed.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokens, trees and components aren't expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = written(made, f"pipeline-{name}")
        removed(made)  # tables of the shared folder that only this stage read
    return STAGES[-1][1](spark, docs, sf_dir)
