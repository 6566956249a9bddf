"""Corpus pipeline: quality and language filters, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of ``documents``; the last returns the pieces of packed
sequences. ``run`` writes each stage's rows to the shared scratch folder and
reads them back, as a driver of the stages would, and drops its input.

Defined cases: a null or empty text is of no quality and goes with the first
stage; rows that share a doc_id are judged each by its own text, until the join
keeps one of them; of near-duplicates the smallest doc_id stays; ties go as the
operators say; an empty table passes every stage as one; columns but those of
``documents`` are left out, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annalist.llm import language, packing, quality, secrets, shingles
from annalist.llm.common import discard, materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, by its own decision."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names."""
    docs = docs.select(*COLUMNS)
    return language.keep_known(docs, language.fit(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return shingles.keep_one(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted."""
    return secrets.redact_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("ngram_jaccard_join", distinct_documents),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]
#: Votes, n-gram models and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, rows = rows, materialise(stage(spark, rows, sf_dir), name)
        discard(before)
        release(spark)
    return STAGES[-1][1](spark, rows, sf_dir)
