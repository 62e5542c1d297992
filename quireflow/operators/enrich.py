"""Neighbours of figures: captions and context, by windows over a page's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def _near(name: str, offset: int):
    at = W.partitionBy("doc_id", "page").orderBy("reading_order")
    return F.lead(name, offset).over(at) if offset > 0 else F.lag(name, -offset).over(at)


def nearby_captions(blocks: DataFrame, reach: int = 3, short: int = 200) -> DataFrame:
    """blocks with caption: the next text (after before before, by distance) that names a figure, else a short neighbour."""
    named, brief = [], []
    for k in range(1, reach + 1):
        for offset in (k, -k):
            t, kind = F.trim(_near("text", offset)), _near("type", offset)
            fit = kind.isin("caption", "paragraph") & (t != "")
            named.append(F.when(fit & (tx.figure_reference(t) != ""), t))
            if k == 1:
                brief.append(F.when(fit & (F.length(t) < short), t))
    return blocks.withColumn("caption", F.coalesce(*named, *brief, F.lit("")))


def context_snippets(blocks: DataFrame, most: int = 200) -> DataFrame:
    """blocks with context: the neighbours' beginnings, headers and footers left out."""
    parts = []
    for offset in (-1, 1):
        ok = ~_near("type", offset).isin("header", "footer") & (F.trim(_near("text", offset)) != "")
        parts.append(F.when(ok, F.substring(F.trim(_near("text", offset)), 1, most)))
    return blocks.withColumn("context", F.concat_ws(" [...] ", *parts))


def paragraph_clusters(lines: DataFrame, gap: float = 15.0) -> DataFrame:
    """lines (doc_id, page, ord, box) with cluster: a new one begins where the gap to all before is wide."""
    at = W.partitionBy("doc_id", "page").orderBy("box.y0", "ord")
    lowest = F.max("box.y1").over(at.rowsBetween(W.unboundedPreceding, -1))
    starts = F.coalesce(F.col("box.y0") - lowest > gap, F.lit(True))
    return lines.withColumn("starts", starts.cast("int")).withColumn("cluster", F.sum("starts").over(at.rowsBetween(W.unboundedPreceding, 0))).drop("starts")


def line_clusters(words: DataFrame, gap: float = 5.0) -> DataFrame:
    """words (doc_id, page, top, x0, text) as lines: doc_id, page, line, text.

    A line begins where a word's top differs by more than gap from the top of the line's first word: a fold over the
    page's words, which are bounded by the page.
    """
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("words"))
    empty = F.expr("cast(array() as array<struct<top:double,text:string>>)")

    def step(lines, word):
        last = F.get(lines, F.size(lines) - 1)
        joined = F.struct(last["top"].alias("top"), F.concat(last["text"], F.lit(" "), word["text"]).alias("text"))
        same = (F.size(lines) > 0) & (F.abs(word["top"] - last["top"]) <= gap)
        begun = F.struct(word["top"].alias("top"), word["text"].alias("text"))
        return F.when(same, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(lines, F.array(begun)))

    lines = pages.select("doc_id", "page", F.posexplode(F.aggregate("words", empty, step)).alias("line", "l"))
    return lines.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.col("l.text").alias("text"))


def caption_counts(captions: DataFrame, key: str) -> DataFrame:
    """key, refined, failed: how many of the captions (key, text) that a model gave are taken and how many aren't."""
    ok = tx.caption_ok(F.col("text"))
    return captions.groupBy(key).agg(F.count_if(ok).alias("refined"), F.count_if(~ok).alias("failed"))
