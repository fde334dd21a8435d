"""Corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the docs of the next one. All
but the last keep the columns of `documents`; where a stage changes a text,
n_chars is that of the new text.

SQL cannot express the stages (naive Bayes, tokenizers), so ORACLE_SQL is None:
tests hold each stage against a brute-force version on its own input, and run()
against the stages one after another.

In all stages: other columns are kept whatever their names, rows keep their doc_id,
a null doc_id is a row like any other, a repeated row gives repeated results, texts
are taken whole however long, and an empty table gives an empty one. What is special
to a stage stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerframe.llm import language_id, ngram_join, packing, pii, substring
from ledgerframe.llm.workspace import store

ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined. Null and empty texts, and texts without a letter, go; of equal posteriors the first language in the alphabet counts."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies.

    Texts without words are alone and stay. Rows that share a doc_id are one document and stay or go together; a row
    without a doc_id stays only if its group has no other id.
    """
    kept = ngram_join.groups(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document, or the same one, already holds.

    Null stays null; a text that loses nothing stays as it is, white space included. Equal rows are not repeats of each other.
    """
    return _recounted(substring.dedup_text(docs))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked and the terms that disclose it generalised or removed. Null stays null; overlapping finds are masked once."""
    return _recounted(pii.sanitise(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in the training sequences. Null and empty texts are an end token; equal lengths are placed in the order of doc_id."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("pii_sanitisation", mask_pii),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
