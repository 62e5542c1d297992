"""The engine's base relations: blocks from text lines, line pairs and a Markdown report; regions; page signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, geometry, text

PER_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_blocks(documents: DataFrame) -> DataFrame:
    """One block for each line that is not blank: doc_id, page, ord, provider, type, text, box, confidence."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text")).where(F.trim("text") != "")
    at = F.col("idx") % PER_PAGE
    return lines.select(
        "doc_id",
        (F.floor(F.col("idx") / PER_PAGE) + 1).cast("int").alias("page"),
        F.col("idx").cast("long").alias("ord"),
        F.lit("lines").alias("provider"),
        classify.markdown_type(F.col("text")).alias("type"),
        "text",
        geometry.stacked_box(at.cast("double")).alias("box"),
        F.lit(0.85).alias("confidence"),
    )


def pair_blocks(documents: DataFrame) -> DataFrame:
    """As line_blocks, two lines to a block on odd pages, of lower confidence: many overlap the lines' blocks."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text")).where(F.trim("text") != "")
    page = (F.floor(F.col("idx") / PER_PAGE) + 1).cast("int")
    step = F.when(page % 2 == 1, 2).otherwise(1)
    lines = lines.withColumn("page", page).withColumn("first", F.col("idx") - F.col("idx") % step)
    pairs = lines.groupBy("doc_id", "page", "first").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("parts"), F.max("idx").alias("last"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    top, bottom = (F.col("first") % PER_PAGE) * 50.0, (F.col("last") % PER_PAGE + 1) * 50.0
    shape = F.struct(F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(612.0).alias("x1"), bottom.alias("y1"))
    return pairs.select("doc_id", "page", F.col("first").cast("long").alias("ord"), F.lit("paras").alias("provider"), classify.markdown_type(joined).alias("type"), joined.alias("text"), shape.alias("box"), F.lit(0.7).alias("confidence"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report for each nation, which has paragraphs of all types: doc_id, ord, text."""
    nation, supplier, part = (table(spark, sf_dir, x) for x in ("nation", "supplier", "part"))
    doc, base = F.col("n_nationkey").cast("long"), F.col("p_partkey") * 6 + 1_000_000
    rows = [
        nation.select(doc.alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("# "), "n_name").alias("text")),
        nation.select(doc, F.lit(1).cast("long"), F.concat(F.lit("The nation "), "n_name", F.lit(" lies in region "), F.col("n_regionkey").cast("string"), F.lit("."))),
        supplier.select(F.col("s_nationkey").cast("long"), F.col("s_suppkey") + 10, F.concat(F.lit("- "), "s_name")),
    ]
    for k, shape in enumerate([("### ", "p_name", ""), ("| ", "p_brand", " | x |"), ("$$", "p_size", "$$"), ("![", "p_name", "](part.png)"), ("```", "p_type", "```"), ("", "p_size", ". item")]):
        rows.append(part.select((F.col("p_partkey") % 25).cast("long"), (base + k).cast("long"), F.concat(F.lit(shape[0]), F.col(shape[1]).cast("string"), F.lit(shape[2]))))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def page_signals(documents: DataFrame) -> DataFrame:
    """Signals of each page: doc_id, page, has_text, density, equations, tables, language, chars, columns.

    Lines are as wide as the page, so there is one column.
    """
    pages = line_blocks(documents).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    t = pages.select("doc_id", "page", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    has = F.length(F.trim("text")) > 0
    return t.select("doc_id", "page", has.alias("has_text"), geometry.density(F.col("text"), has).alias("density"), text.has_equation(F.col("text")).alias("equations"), text.has_table(F.col("text")).alias("tables"), text.language(F.col("text")).alias("language"), F.length("text").cast("long").alias("chars"), F.lit(1).alias("columns"))


def regions(blocks: DataFrame, size: int = 5) -> DataFrame:
    """Regions of `size` neighbouring blocks of a page: doc_id, page, region, type (of the first block), box, blocks."""
    at = W.partitionBy("doc_id", "page").orderBy("ord")
    numbered = blocks.withColumn("region", F.floor((F.row_number().over(at) - 1) / size).cast("int"))
    first = F.min_by("text", "ord")
    shape = F.struct(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
    out = numbered.groupBy("doc_id", "page", "region").agg(first.alias("text"), shape.alias("box"), F.count("*").alias("blocks"))
    return out.select("doc_id", "page", "region", classify.region_type(F.col("text")).alias("type"), "box", "blocks")
