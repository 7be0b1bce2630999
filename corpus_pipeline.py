"""Corpus pipeline: documents through five of the training-data operators, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Rows with nulls, empty texts, ties and repeated rows follow the operators' own definitions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.llm import byte_bpe, dart_minhash, quality_lines, secret_scan, winnow
from folioquarry.llm.common import new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    return quality_lines.retain(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates (five words, similarity 0.8)."""
    return dart_minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts hold no window of a benchmark item."""
    return winnow.retain(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and n_tokens of all documents."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secret scan", redact_secrets), ("byte-level encoding", encode)]

#: SQL cannot express the trained and hashed stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what lies between is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
