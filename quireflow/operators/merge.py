"""Joining regions with provider blocks by overlap, greedy de-duplication and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry

OVERLAP, SAME = 0.3, 0.8


def match_blocks(regions: DataFrame, blocks: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Blocks that lie in a region by at least `least` of their area; a region without area takes its whole page.

    An equi-join on document and page with the overlap as residual predicate.
    """
    r = regions.select("doc_id", "page", "region", F.col("type").alias("region_type"), F.col("box").alias("region_box"))
    joined = r.join(blocks, ["doc_id", "page"])
    return joined.where((geometry.area(F.col("region_box")) <= 0) | (geometry.share_of(F.col("box"), F.col("region_box")) >= least))


def first_provider(matched: DataFrame, order: list[str]) -> DataFrame:
    """Of each region's matches those of the first provider in order that has any."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    ranked = matched.withColumn("place", place).withColumn("least", F.min("place").over(W.partitionBy("doc_id", "page", "region")))
    return ranked.where(F.col("place") == F.col("least")).drop("place", "least")


def first_in_chain(matched: DataFrame, routed: DataFrame) -> DataFrame:
    """Of each region's matches those of the first provider that has any: the region's best one, then its chain.

    routed: doc_id, page, region, best, chain. Blocks of providers outside the chain are not taken.
    """
    order = F.concat(F.array("best"), F.col("chain"))
    plan = routed.select("doc_id", "page", "region", order.alias("__order"))
    ranked = matched.join(plan, ["doc_id", "page", "region"]).withColumn("__place", F.array_position("__order", F.col("provider"))).where("__place > 0")
    least = F.min("__place").over(W.partitionBy("doc_id", "page", "region"))
    return ranked.withColumn("__least", least).where("__place = __least").drop("__order", "__place", "__least")


def fill_pages(blocks: DataFrame, spare: DataFrame) -> DataFrame:
    """blocks, and those of spare on pages (doc_id, page) that have none."""
    return blocks.unionByName(spare.join(blocks.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))


def drop_overlapping(blocks: DataFrame, same: float = SAME) -> DataFrame:
    """Greedy de-duplication of each page's blocks: by falling confidence, a block stays if no kept one is the same.

    A page's blocks are bounded by the page; ties are broken by provider and ord.
    """
    member = F.struct((-F.col("confidence")).alias("rank"), "provider", "ord", "type", "text", "box", "confidence")
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(member)).alias("all"))

    def step(kept, block):
        return F.when(F.exists(kept, lambda k: geometry.iou(k["box"], block["box"]) > same), kept).otherwise(F.concat(kept, F.array(block)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return pages.select("doc_id", "page", F.inline(kept)).drop("rank")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with reading_order: from 0 in each document by page, top and left edge."""
    at = W.partitionBy("doc_id").orderBy("page", "box.y0", "box.x0", "provider", "ord")
    return blocks.withColumn("reading_order", (F.row_number().over(at) - 1).cast("long"))


def page_order(blocks: DataFrame) -> DataFrame:
    """blocks with reading_order: from 0 in each page."""
    at = W.partitionBy("doc_id", "page").orderBy("box.y0", "box.x0", "provider", "ord")
    return blocks.withColumn("reading_order", (F.row_number().over(at) - 1).cast("long"))
