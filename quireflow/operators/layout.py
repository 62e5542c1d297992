"""Layout JSON and page bookkeeping: scans, gap filling, subsets, words outside tables, rewriting of links."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.classify import BLOCK_TYPES

SCHEMA = "struct<page_number:int,width:double,height:double,segments:array<struct<block_type:string,bbox:array<double>,text_hint:string,confidence:double>>>"


def parse_layout(layouts: DataFrame) -> DataFrame:
    """doc_id, page, seg, type, box, hint, confidence of layouts (doc_id, layout as JSON).

    Boxes of fewer than four numbers, or narrower or lower than 1, are dropped; corners are put in order; unknown
    types are paragraphs; a text that isn't JSON gives no rows.
    """
    parsed = layouts.select("doc_id", F.from_json("layout", SCHEMA, {"mode": "PERMISSIVE"}).alias("l"))
    rows = parsed.select("doc_id", F.coalesce("l.page_number", F.lit(1)).alias("page"), F.posexplode("l.segments").alias("seg", "s")).where(F.size("s.bbox") >= 4)
    b = F.col("s.bbox")
    shape = geometry.box(b[0], b[1], b[2], b[3])
    kind = F.when(F.col("s.block_type").isin(BLOCK_TYPES), F.col("s.block_type")).otherwise("paragraph")
    out = rows.select("doc_id", "page", F.col("seg").cast("long").alias("seg"), kind.alias("type"), shape.alias("box"), F.substring(F.coalesce("s.text_hint", F.lit("")), 1, 500).alias("hint"), F.coalesce("s.confidence", F.lit(0.82)).alias("confidence"))
    return out.where((F.col("box.x1") - F.col("box.x0") >= 1) & (F.col("box.y1") - F.col("box.y0") >= 1))


def fill_gaps(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """primary, and of fallback the pages that primary has nothing for (doc_id, page, ..., the same columns)."""
    return primary.unionByName(fallback.join(primary.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").select(*primary.columns))


def renumber(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks of a subset with the original page numbers; pages: doc_id, page (of the subset), original."""
    return blocks.join(pages, ["doc_id", "page"]).drop("page").withColumnRenamed("original", "page").select(*blocks.columns)


def outside_tables(words: DataFrame, tables: DataFrame, slack: float = 2.0) -> DataFrame:
    """words (doc_id, page, box) that lie in no table of their page (box), with some slack."""
    t = tables.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("box").alias("t"))
    b, inside = F.col("box"), F.lit(True)
    for low, high in (("x0", "x1"), ("y0", "y1")):
        inside = inside & (b[low] >= F.col("t")[low] - slack) & (b[high] <= F.col("t")[high] + slack)
    return words.join(t, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & inside, "left_anti")


def missing_figures(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Figure blocks for images (doc_id, page, idx, path) of pages that have no figure: doc_id, page, ord, path."""
    bare = images.join(blocks.where("type = 'figure'").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    last = blocks.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return bare.join(last, ["doc_id", "page"], "left").select("doc_id", "page", (F.coalesce("n", F.lit(0)) + F.col("idx")).alias("ord"), "path")


def first_of_page(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk, page, text): of a page that several chunks have, the first."""
    at = W.partitionBy("doc_id", "page").orderBy("chunk")
    return chunks.withColumn("k", F.row_number().over(at)).where("k = 1").drop("k")


def flatten_elements(layouts: DataFrame) -> DataFrame:
    """doc_id, ord, type, content of nested JSON: lists and kids are gone through, what has type and content is kept."""

    def walk(x) -> Iterator[tuple[str, str]]:
        if isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, dict):
            if x.get("kids"):
                yield from walk(x["kids"])
            elif x.get("type") and x.get("content"):
                yield str(x["type"]), str(x["content"])
            elif "elements" in x:
                yield from walk(x["elements"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["layout"], strict=True):
                try:
                    found = walk(json.loads(text or "null"))
                except ValueError:
                    continue
                rows += [(i, k, kind, content) for k, (kind, content) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "type", "content"])

    return layouts.select("doc_id", "layout").mapInPandas(run, "doc_id long, ord long, type string, content string")


def align_paragraphs(paragraphs: DataFrame, pages: DataFrame, back: int = 1, ahead: int = 4) -> DataFrame:
    """doc_id, idx, page: paragraphs (doc_id, idx, text) set to the pages (doc_id, page, text) whose words they share most.

    A fold over a document's paragraphs: the page never falls, and only the pages near the last one are looked at; a
    paragraph that shares nothing stays on the last page. One document is one group, as in any reader.
    """
    own = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", _words("text").alias("w")))).alias("paras"))
    there = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", _words("text").alias("w")))).alias("pages"))
    start = F.struct(F.lit(1).alias("last"), F.expr("cast(array() as array<struct<idx:bigint,page:int>>)").alias("out"))

    def step(acc, para):
        near = F.filter("pages", lambda p: (p["page"] >= acc["last"] - back) & (p["page"] < acc["last"] + ahead))
        scored = F.transform(near, lambda p: F.struct(F.size(F.array_intersect(p["w"], para["w"])).alias("n"), (-p["page"]).alias("rank")))
        best = F.array_max(scored)
        page = F.when(F.coalesce(best["n"], F.lit(0)) > 0, F.greatest(acc["last"], -best["rank"])).otherwise(acc["last"]).cast("int")
        return F.struct(page.alias("last"), F.concat(acc["out"], F.array(F.struct(para["idx"].cast("bigint").alias("idx"), page.alias("page")))).alias("out"))

    return own.join(there, "doc_id").select("doc_id", F.inline(F.aggregate("paras", start, step)["out"]))


def _words(name: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def text_fallback(texts: DataFrame) -> DataFrame:
    """doc_id, idx, text, confidence: paragraphs between blank lines; one empty paragraph for a text without any."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = texts.select("doc_id", F.posexplode_outer(parts).alias("idx", "t"))
    return rows.select("doc_id", F.coalesce("idx", F.lit(0)).cast("long").alias("idx"), F.coalesce("t", F.lit("")).alias("text"), F.when(F.col("t").isNull(), 0.3).otherwise(0.5).alias("confidence"))


def rewrite_links(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """blocks (block_id, path) with target: the link (path, target) of that name, else one whose name contains it or lies in it."""
    exact = blocks.join(links.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left").drop("p")
    rest = exact.where("target IS NULL").drop("target")
    near = rest.join(links.select(F.col("path").alias("p"), "target"), F.contains("path", F.col("p")) | F.contains("p", F.col("path")))
    found = near.groupBy("block_id", "path").agg(F.min_by("target", "p").alias("target"))
    open_ = rest.join(found.select("block_id", "target"), "block_id", "left")
    return exact.where("target IS NOT NULL").unionByName(open_.withColumn("target", F.coalesce("target", "path")))


def first_success_text(candidates: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, provider, text of candidates (doc_id, pos, provider, text): the first long enough."""
    good = candidates.where(F.length(F.trim("text")) > least)
    return good.groupBy("doc_id").agg(F.min_by(F.struct("provider", "text"), "pos").alias("b")).select("doc_id", "b.*")
