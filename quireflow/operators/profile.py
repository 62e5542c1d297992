"""Profiles of documents and quality of layouts, from page signals and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify


def document_profile(signals: DataFrame) -> DataFrame:
    """doc_id, pages, math, tables, scanned, multi_column, complexity (0 to 1), dominant.

    signals: doc_id, density, equations, tables, has_text, columns (an estimate, null for none).
    """
    wide = F.coalesce(F.col("columns"), F.lit(1)) > 1
    weight = F.col("density") + F.when(F.col("equations"), 0.2).otherwise(0.0) + F.when(F.col("tables"), 0.2).otherwise(0.0) + F.when(wide, 0.1).otherwise(0.0)
    out = signals.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.bool_or("equations").alias("math"),
        F.bool_or("tables").alias("tables"),
        (F.count_if(~F.col("has_text")) > 0.5 * F.count("*")).alias("scanned"),
        F.bool_or(wide).alias("multi_column"),
        F.least(F.sum(weight.cast("decimal(20,10)")).cast("double") / F.count("*"), F.lit(1.0)).alias("complexity"),
    )
    return out.withColumn("dominant", classify.dominant_document_type(F.col("pages"), F.col("math"), F.col("tables"), F.col("scanned"), F.col("multi_column")))


def layout_quality(regions: DataFrame, width: float = 612.0, height: float = 1000.0, slack: float = 10.0) -> DataFrame:
    """doc_id, page, quality: many regions and a table or figure are good, boxes off the page or without area bad."""
    b = F.col("box")
    off = (b["x0"] < -slack) | (b["y0"] < -slack) | (b["x1"] > max(width, 1.0) + slack) | (b["y1"] > max(height, 1.0) + slack)
    bad = F.count_if(off | (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"]))
    rich = F.bool_or(F.col("type").isin("table", "figure"))
    score = F.least(F.lit(1.0), 0.08 * F.count("*")) + F.when(rich, 0.12).otherwise(0.0) - F.least(F.lit(0.4), 0.05 * bad)
    return regions.groupBy("doc_id", "page").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("quality"))


def has_text_layer(signals: DataFrame, first: int = 3, least: int = 50, share: float = 0.6) -> DataFrame:
    """doc_id, text_layer: enough of the first pages have text."""
    return signals.where(F.col("page") <= first).groupBy("doc_id").agg((F.avg(F.when(F.col("chars") > least, 1.0).otherwise(0.0)) >= share).alias("text_layer"))


def column_estimate(blocks: DataFrame, width: float) -> DataFrame:
    """doc_id, page, columns: 2 if there are four text blocks and more than 0.3 of them lie on either side, else 1.

    blocks: doc_id, page, box, of text only.
    """
    centre = (F.col("box.x0") + F.col("box.x1")) / 2 / F.lit(width)
    left, right, n = F.count_if(centre < 0.4), F.count_if(centre > 0.6), F.count("*")
    two = (n >= 4) & (F.lit(width) > 0) & (left > n * 0.3) & (right > n * 0.3)
    return blocks.groupBy("doc_id", "page").agg(F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("columns"))
