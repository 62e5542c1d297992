"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the folder that the
cluster shares and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.llm.bpe import tokenised
from quireflow.llm.classifier import keep_good
from quireflow.llm.common import materialize
from quireflow.llm.exact_dedup import drop_exact_copies
from quireflow.llm.minhash_dedup import drop_near_copies
from quireflow.llm.mixing import mix_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    return keep_good(spark, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the copy with the largest doc_id of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates (five words, 0.8)."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them, repeated ones once for each pass."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return tokenised(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("source mix", mix), ("byte-level bpe", encode)]

#: The classifier, which is fitted with floating-point steps, has no SQL; tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
