"""A corpus pipeline of five operators: language, quality rules, near copies, benchmark passages, tokens.

Every stage takes (session, documents, folder of tables) and returns a table; ``run`` writes each as
Parquet in the shared folder and reads it back as the next stage's documents. All stages but the
last return the columns of documents; the last returns each document's token digests.

All stages take null keys, null, empty and very long texts, repeated rows, empty tables and further columns of any
name; what becomes of them stands at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import byte_bpe, centroid_lang, common, decontam, quality_rules, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of a language learned from the labelled documents that teach.

    Out go null and empty texts, texts without a letter, and texts below the floor of their nearest language: prose in
    languages that no document is labelled with, random letters, one word over and over. Repeated rows stay or go
    together; ties go to the language that sorts first; without labelled documents none is near any, so all go.
    """
    return centroid_lang.filter_documents(docs, centroid_lang.fit(docs.where(~centroid_lang.held_out())))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy text-1 keeps, by the ledger beside their columns.

    Null, empty and blank texts fail few_words and go. Long texts are measured whole; a document at a rule's very limit
    stays; repeated rows stay or go together.
    """
    return quality_rules.filter_documents(docs, "text-1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id.

    Null, empty and blank texts are one component. Rows that share a doc_id count as one document, the smallest text
    stays; of rows without doc_id one stays for each fingerprint that no row with one has.
    """
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; an empty benchmark lets all stay; repeated rows stay or go together.
    """
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, row by row; null and empty texts have no tokens."""
    return byte_bpe.encode(docs, common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("language ID", language_id),
    ("quality rules", rules),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", tokens),
]

#: The nearest-centroid stage is learned, which SQL can't express; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = common.stash(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
