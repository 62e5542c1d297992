"""File sources and sinks: folders of texts and binary files in, Markdown and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits on what is accepted.
MAX_BYTES, MAGIC = 200 << 20, "25504446"


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, text of a folder's files, each as one row."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, length, content, digest, ok: files with whether they are accepted (size, leading bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    ok = (F.col("length") <= MAX_BYTES) & (F.hex(F.substring("content", 1, 4)) == MAGIC)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("digest"), ok.alias("ok"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (doc_id, page, markdown) as JSON, a folder for each of 256 hash ranges of documents; reruns overwrite."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(256))
    pages.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents (doc_id, pages, markdown) as Parquet."""
    documents.write.mode("overwrite").parquet(path)


def cache_put(cache_path: str, results: DataFrame) -> None:
    """Adds results (file_hash, engine, page_limit, payload) to a cache; partitions that they have are replaced.

    Empty payloads are not kept, and the page limit is part of the key, so cut results never serve whole runs.
    """
    kept = results.where(F.coalesce(F.length("payload"), F.lit(0)) > 0).withColumn("part", F.substring("file_hash", 1, 2))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engine", "part").parquet(cache_path)


def cache_miss(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """wanted (file_hash, engine, page_limit) that is not cached."""
    return wanted.join(cached, ["file_hash", "engine", "page_limit"], "left_anti")
