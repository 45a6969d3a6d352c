"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs. All but
the last return the columns of docs. What each decides: documents that the classifier rejects go; of each group of linked
documents the one with the smallest id stays; words of repeated 50-word windows go from texts; documents with a word
of a benchmark window go; the last returns the digests of each document's ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from proofgrid.llm import decontamination, jaccard, pieces, quality, substrings
from proofgrid.llm.shared import folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the classifier's threshold; the others go. Null and empty texts are scored by the bias alone, repeated
    rows alike, a very long text whole; a null id is never trained on; an empty table stays empty; other columns stay as they are."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id, and one row of those that share its id and group. Documents without words
    link with nothing, rows without id all stay; texts and other columns stay as they are."""
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 50-word windows that a document with a smaller id has too. A text that loses nothing stays as it is, null
    and empty ones too; one that loses words is its other words joined by one space, and n_chars follows; a null id sorts last; other columns
    stay as they are, repeated rows alike."""
    return substrings.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a word of a benchmark window; null and empty texts have none and stay, an empty benchmark drops nothing, items without id
    count like others; other columns stay as they are, repeated rows alike."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; a null text is empty, repeated rows alike, an empty table stays empty."""
    return pieces.digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_encoding),
]

#: The classifier and the tokenizer cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/proofgrid/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
