"""The flagship plan: documents to Markdown by way of regions, providers, matching, de-duplication and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, relations, render, route


#: Which providers of the chains the two block readers stand for.
READERS = {"lines": "marker", "paras": "docling"}


def provider_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of all readers, each under the name of the provider that it stands for."""
    readers = {"lines": relations.line_blocks(documents), "paras": relations.pair_blocks(documents)}
    first, *rest = [df.withColumn("provider", F.lit(READERS[name])) for name, df in readers.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


def convert_blocks(documents: DataFrame) -> DataFrame:
    """The blocks that are kept of a document, in reading order.

    Every region takes the blocks of the first provider of its routing that has some; pages that end up without any
    are read by lines; near-equal boxes are dropped. Documents, pages and regions are partitioned alike throughout.
    """
    lines, blocks = relations.line_blocks(documents), provider_blocks(documents)
    regions = relations.regions(lines)
    matched = merge.first_in_chain(merge.match_blocks(regions, blocks), route.route_regions(regions))
    found = matched.select(*blocks.columns).dropDuplicates(["doc_id", "page", "provider", "ord"])
    every = merge.fill_pages(found, lines.withColumn("provider", F.lit("lines")))
    return merge.reading_order(merge.drop_overlapping(every))


def convert_pages(documents: DataFrame) -> DataFrame:
    """doc_id, page, markdown."""
    return render.page_markdown(convert_blocks(documents))


def convert_documents(documents: DataFrame) -> DataFrame:
    """doc_id, pages, markdown: the pages joined and their running text repaired."""
    whole = render.document_markdown(convert_pages(documents))
    return render.beautify(whole).join(whole.select("doc_id", "pages"), "doc_id").select("doc_id", "pages", "markdown")


def convert_lines(documents: DataFrame) -> DataFrame:
    """doc_id, page, markdown by the line provider alone."""
    return render.page_markdown(merge.page_order(relations.line_blocks(documents)))


def routing_plan(documents: DataFrame, gpu: bool = True) -> DataFrame:
    """Regions with the provider that suits each best."""
    return route.route_regions(relations.regions(relations.line_blocks(documents)), gpu)
