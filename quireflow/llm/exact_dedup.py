"""Exact de-duplication by skew-safe combining.

Whole normalised texts are compared, not only their digests:

1. every task folds the copies it holds (map-side aggregation by digest and text), so that a group of copies, even one
   that holds a third of all rows, leaves a task as one row,
2. these rows meet by digest and text, which is the only time that whole texts are shuffled to find the groups.

The winners go back to the rows by digest alone, which is a narrow join that AQE can split; digests that stand for more
than one text (only possible with a weak digest) take a second join that compares the texts themselves.

Defined results: null text counts as empty; empty texts form one group; null ids never win over others, and a
group of null ids only keeps all of them (keep_id null); rows that repeat an id with the same text are one
document, each row is returned and has the same decision; an empty table gives no rows; further columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, kept

#: Digests of dropped copies are broadcast below this many bytes; above, the rows are shuffled to them.
BROADCAST_BYTES = 48 << 20


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _groups(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows (id, t, h); a row for each digest of one text (h, keep, n); of digests of more texts, one for each text (h, t, keep, n)."""
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("t")).withColumn("h", digest(F.col("t")))
    winners = rows.groupBy("h", "t").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    texts = kept(winners.groupBy("h").agg(F.count("*").alias("texts"), F.max("keep").alias("keep"), F.max("n").alias("n")))
    doubtful = texts.where("texts > 1").select("h")
    return rows, texts.where("texts = 1").drop("texts"), None if doubtful.isEmpty() else winners.join(doubtful, "h", "left_semi")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    rows, texts, whole = _groups(docs, id_col, text_col, digest)
    out = rows.select("id", "h", F.sha2("t", 256).alias("sha")).join(texts, "h").select("id", "keep", "n", "sha")
    if whole:
        out = out.unionByName(rows.join(whole, ["h", "t"]).select("id", "keep", "n", F.sha2("t", 256).alias("sha")))
    stays = F.coalesce(F.col("id") == F.col("keep"), F.col("keep").isNull())
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs that stay, with all their columns: those go, by id and text, that exact_groups() doesn't keep."""
    _, texts, whole = _groups(docs, id_col, text_col, digest)
    text = ascii_lower(docs[text_col])
    for more, same in ((texts, F.lit(True)), (whole, text == F.col("__t"))):
        if more:
            gone = more.where("n > 1 AND keep IS NOT NULL").select(*(F.col(c).alias(f"__{c}") for c in more.columns if c != "n"))
            if more is texts:
                row = F.octet_length("__h") + F.octet_length(F.col("__keep").cast("string")) + 64
                if (gone.agg(F.sum(row)).first()[0] or 0) < BROADCAST_BYTES:
                    gone = F.broadcast(gone)
            docs = docs.join(gone, (digest(text) == gone["__h"]) & same & ~docs[id_col].eqNullSafe(gone["__keep"]), "left_anti")
    return docs


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
