"""A corpus from raw documents: rules, near-duplicates, secrets, mixture, tokens.

Each stage takes what the one before it kept, written as Parquet and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import bpe, mixing, near_dup, quality_rules, secret_scan
from frostline.llm.common import DOCUMENT_COLUMNS, table
from frostline.llm.queries import vocabulary
from frostline.session import write_scratch


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = quality_rules.trusted_documents(table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, trusted, keep=DOCUMENT_COLUMNS)
    return judged.where("kept").select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_one(docs.select(*DOCUMENT_COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    clean = secret_scan.redact(docs.select(*DOCUMENT_COLUMNS))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document in the mixture."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path), path)


STAGES = [
    ("quality rules", apply_rules),
    ("near-duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixture", mix_sources),
    ("byte-level BPE", encode_bytes),
]

# Hashed n-grams, sketches and merges are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
