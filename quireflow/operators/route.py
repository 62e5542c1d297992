"""Routing regions to extraction providers: chains by block type, scores, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import adapted_type

#: Which providers are tried for a block type, in order, and which of them need a GPU.
CHAINS = {
    "paragraph": ["marker", "docling", "markitdown"],
    "table": ["docling", "mineru", "marker"],
    "equation": ["mineru", "marker", "docling"],
    "figure": ["marker", "docling", "mineru"],
    "heading": ["marker", "docling", "markitdown"],
    "list": ["marker", "docling", "markitdown"],
    "code": ["marker", "markitdown", "docling"],
    "caption": ["marker", "docling", "markitdown"],
    "footer": ["markitdown", "marker", "docling"],
    "header": ["markitdown", "marker", "docling"],
    "other": ["marker", "docling", "markitdown"],
}
GPU = ["marker", "docling", "mineru"]
#: How well a provider supports each block type.
SCORES = {
    "marker": {"paragraph": 0.9, "table": 0.7, "equation": 0.6, "figure": 0.5, "heading": 0.95, "list": 0.8, "code": 0.7, "caption": 0.6, "footer": 0.5, "header": 0.5, "other": 0.7},
    "docling": {"paragraph": 0.9, "table": 0.98, "equation": 0.85, "figure": 0.9, "heading": 0.95, "list": 0.85, "code": 0.8, "caption": 0.8, "footer": 0.5, "header": 0.5, "other": 0.8},
    "mineru": {"paragraph": 0.85, "table": 0.95, "equation": 0.98, "figure": 0.85, "heading": 0.9, "list": 0.7, "code": 0.8, "caption": 0.7, "footer": 0.5, "header": 0.5, "other": 0.75},
    "markitdown": {"paragraph": 0.7, "table": 0.5, "equation": 0.4, "figure": 0.4, "heading": 0.8, "list": 0.75, "code": 0.9, "caption": 0.6, "footer": 0.7, "header": 0.7, "other": 0.6},
}


def chains(spark: SparkSession, gpu: bool = True, available: list[str] | None = None, override: dict[str, list[str]] | None = None) -> DataFrame:
    """type, pos, provider, score: the filtered chains. Small.

    Without a GPU a chain of nothing else stays as it is; where no provider of a chain is available, those that need
    least stand in. override: chains in place of the fixed ones. Providers without a score have 0.5.
    """
    rows = []
    for kind, chain in (CHAINS | (override or {})).items():
        own = [p for p in chain if gpu or p not in GPU] or chain
        if available:
            own = [p for p in own if p in available] or [p for p in ("marker", "markitdown") if p in available] or ["marker"]
        rows += [(kind, k, p, SCORES.get(p, {}).get(kind, 0.5)) for k, p in enumerate(own)]
    return spark.createDataFrame(rows, "type string, pos int, provider string, score double")


def route_regions(regions: DataFrame, gpu: bool = True, available: list[str] | None = None, override: dict[str, list[str]] | None = None) -> DataFrame:
    """regions with best (highest score, earlier in the chain on ties), score and chain."""
    table = chains(regions.sparkSession, gpu, available, override)
    best = table.groupBy("type").agg(F.max_by("provider", F.struct("score", -F.col("pos"))).alias("best"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "provider"))).alias("c"))
    best = best.select("type", "best", "score", F.transform("c", lambda x: x["provider"]).alias("chain"))
    known = adapted_type(F.col("type"), "paragraph")
    return regions.withColumn("kind", known).join(F.broadcast(best.withColumnRenamed("type", "kind")), "kind").drop("kind")  # eleven rows


def providers_needed(routed: DataFrame) -> DataFrame:
    """doc_id, page, provider: all of the chains of a page's regions."""
    return routed.select("doc_id", "page", F.explode("chain").alias("provider")).distinct()


def provider_pages(routed: DataFrame) -> DataFrame:
    """provider, doc_id, pages: on how many pages a provider is the best of some region."""
    return routed.groupBy(F.col("best").alias("provider"), "doc_id").agg(F.count_distinct("page").alias("pages"))


def second_pass(routed: DataFrame, threshold: float = 0.65, without: tuple[str, ...] = ("marker", "opendataloader")) -> DataFrame:
    """doc_id, page, provider: where the score is low, what follows the head of the chain."""
    low = routed.where(F.col("score") < threshold).select("doc_id", "page", F.explode(F.slice("chain", 2, 3)).alias("provider"))
    return low.where(~F.col("provider").isin(*without)).distinct()


def page_ranges(pages: DataFrame) -> DataFrame:
    """provider, doc_id, first, last: runs of pages (provider, doc_id, page) in a row."""
    at = W.partitionBy("provider", "doc_id").orderBy("page")
    runs = pages.distinct().withColumn("run", F.col("page") - F.row_number().over(at))
    return runs.groupBy("provider", "doc_id", "run").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("run")


def routing_log(routed: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, page, segments, log: for each page its regions in order, as structs, with the blocks found for each.

    matched: rows of blocks that were taken for a region (doc_id, page, region).
    """
    found = matched.groupBy("doc_id", "page", "region").agg(F.count("*").alias("blocks_found"))
    own = routed.join(found, ["doc_id", "page", "region"], "left")
    entry = F.struct(F.col("region").alias("seg_idx"), "type", F.col("best").alias("best_provider"), "score", "chain", F.coalesce("blocks_found", F.lit(0)).alias("blocks_found"))
    return own.groupBy("doc_id", "page").agg(F.count("*").alias("segments"), F.array_sort(F.collect_list(entry)).alias("log"))


def engines(best: Column) -> Column:
    """Distinct engines in order of first use; marker, which reads whole documents, comes first if it is there."""
    once = F.array_distinct(best)
    return F.when(F.array_contains(once, "marker"), F.concat(F.array(F.lit("marker")), F.array_remove(once, "marker"))).otherwise(once)
