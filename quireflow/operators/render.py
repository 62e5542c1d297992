"""Blocks to Markdown: single blocks, pages, documents, and repairs of running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def block_markdown(kind: Column, text: Column, language: Column | None = None) -> Column:
    """A block's Markdown from its text cleaned (code: as it is); null for headers and footers, which are dropped.

    language: of code blocks.
    """
    language = F.lit("") if language is None else language
    t = tx.clean_text(text)
    equation = F.when(F.startswith(t, F.lit("$$")) & F.endswith(t, F.lit("$$")), t).otherwise(F.concat(F.lit("$$\n"), t, F.lit("\n$$")))
    code = F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```"))
    heading = F.concat(F.repeat(F.lit("#"), F.substring(tx.heading_level(t), 2, 1).cast("int")), F.lit(" "), tx.heading_text(t))
    return F.when(kind.isin("header", "footer"), F.lit(None).cast("string")).when(kind == "heading", heading).when(kind == "equation", equation).when(kind == "code", code).when(kind == "caption", F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)


def figure_markdown(figure_id: Column, text: Column, asset: Column, caption: Column, context: Column) -> Column:
    """A figure's link, with its caption or else the context; a note if there is nothing to show."""
    alt = F.coalesce(F.nullif(figure_id, F.lit("")), F.nullif(text, F.lit("")), F.lit("figure"))
    link = F.when(asset != "", F.concat(F.lit("!["), alt, F.lit("]("), asset, F.lit(")")))
    told = F.when(caption != "", F.concat(F.lit("*"), caption, F.lit("*"))).when(context != "", F.concat(F.lit("*[Figure context: "), F.substring(context, 1, 120), F.lit("]*")))
    body = F.concat_ws("\n\n", link, told)
    return F.when(body == "", F.concat(F.lit("[Gorsel: "), alt, F.lit("]"))).otherwise(body)


def page_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, page, markdown: a page's blocks by reading_order, empty ones left out, a blank line between, a newline at the end."""
    shown = blocks.withColumn("md", block_markdown(F.col("type"), F.col("text"))).where(F.coalesce("md", F.lit("")) != "")
    pages = shown.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("reading_order", "md"))).alias("parts"))
    return pages.select("doc_id", "page", F.concat(F.array_join(F.transform("parts", lambda p: p["md"]), "\n\n"), F.lit("\n")).alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """doc_id, pages, markdown: pages with a rule between."""
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "markdown"))).alias("parts"))
    return docs.select("doc_id", F.size("parts").cast("long").alias("pages"), F.array_join(F.transform("parts", lambda p: p["markdown"]), "\n---\n\n").alias("markdown"))


def beautify(texts: DataFrame) -> DataFrame:
    """doc_id, markdown with all repairs of running text: marks, entities, white space, broken sentences, headings, formulas.

    All but headings are expressions on a text; only texts with headings are taken apart by lines.
    """
    t = tx.drop_html_rests(tx.plain_form(tx.drop_replacement(F.col("markdown"))))
    t = tx.merge_broken_sentences(tx.fix_whitespace(t))
    plain = texts.select("doc_id", t.alias("markdown"), F.regexp_count(t, F.lit(r"(?m)^#{1,6}\s")).alias("heads"))
    lines = plain.where("heads > 1").select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("ord", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    level = F.when(level > 0, level).when(F.col("line").rlike(r"^#{1,6}$"), F.length("line"))  # the newline after it was split off
    at = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("level", level).withColumn("rn", F.count("level").over(at))
    clamped = (F.min(F.col("level") - F.col("rn")).over(at) + F.col("rn")).cast("int")
    line = F.when(F.col("level").isNull(), F.col("line")).otherwise(F.concat(F.repeat(F.lit("#"), clamped), F.substr("line", F.col("level") + 1)))
    whole = lines.withColumn("line", line).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("parts"))
    headed = whole.select("doc_id", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("markdown"))
    every = plain.where("coalesce(heads, 0) <= 1").select("doc_id", "markdown").unionByName(headed)
    return every.select("doc_id", tx.sanitize_latex(F.col("markdown")).alias("markdown"))


def clamp_headings(headings: DataFrame) -> DataFrame:
    """headings (doc_id, ord, level) with clamped: a level is at most one deeper than the one before.

    Closed form: with rows numbered, the running minimum of level - number, plus the number.
    """
    at = W.partitionBy("doc_id").orderBy("ord")
    numbered = headings.withColumn("rn", F.row_number().over(at))
    least = F.min(F.col("level") - F.col("rn")).over(at.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("clamped", (least + F.col("rn")).cast("int")).drop("rn")


def split_paragraphs(texts: DataFrame) -> DataFrame:
    """doc_id, idx, text: parts between blank lines; idx counts empty parts, too. texts: doc_id, markdown."""
    parts = texts.select("doc_id", F.posexplode(F.split("markdown", "\n{2,}")).alias("idx", "text"))
    return parts.select("doc_id", F.col("idx").cast("long").alias("idx"), F.trim("text").alias("text")).where("text <> ''")


#: Fixed value: what stands between the pages of an engine's Markdown.
PAGE_MARK = r"\n{0,2}-{48}\n{0,2}"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def split_pages(texts: DataFrame, mark: str = PAGE_MARK) -> DataFrame:
    """doc_id, page (from 1), markdown; empty pages are left out and not numbered."""
    parts = F.filter(F.transform(F.split("markdown", mark), _stripped), lambda x: x != "")
    return texts.select("doc_id", F.posexplode(parts).alias("p", "markdown")).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), "markdown")


def divide_pages(texts: DataFrame) -> DataFrame:
    """doc_id, page (from 1), markdown of texts (doc_id, markdown, pages), for engines that give a document as one text.

    Form feeds part pages, else lines of three dashes; where these give fewer than `pages` parts, lines are dealt so
    that a page ends with the line that fills it to the text's length / pages, and the last takes the rest. No or null
    pages give no rows. The fold holds only where pages end, so it is linear in the lines.
    """
    text, pages = F.col("markdown"), F.col("pages").cast("int")
    marked = F.split(text, F.when(F.contains(text, F.lit("\f")), "\f").otherwise("\n---\n"))
    rows = F.split(text, "\n")
    fill = F.greatest(F.floor(F.length(text) / pages), F.lit(1)).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, line: Column) -> Column:
        at, chars = state["at"] + 1, state["chars"] + F.length(line) + 1
        full = (chars >= F.col("fill")) & (F.size(state["ends"]) + 1 < pages)
        return F.struct(at.alias("at"), F.when(full, 0).otherwise(chars).alias("chars"), F.when(full, F.array_append(state["ends"], at)).otherwise(state["ends"]).alias("ends"))

    known = texts.where((pages > 0) & text.isNotNull()).select("doc_id", "markdown", "pages", marked.alias("marked"))
    by_mark = known.where(F.size("marked") >= pages).select("doc_id", F.posexplode(F.slice("marked", F.lit(1), pages)).alias("p", "part"))
    folded = known.where(F.size("marked") < pages).select("doc_id", "pages", rows.alias("rows"), fill.alias("fill"))
    folded = folded.withColumn("ends", F.aggregate("rows", start, step, lambda s: s["ends"]))
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("ends")).alias("a"), F.concat(F.col("ends"), F.array(F.size("rows"))).alias("z"))
    parts = F.transform(F.filter(bounds, lambda x: x["z"] > x["a"]), lambda x: F.array_join(F.slice(F.col("rows"), x["a"] + 1, x["z"] - x["a"]), "\n"))
    by_length = folded.select("doc_id", F.posexplode(parts).alias("p", "part"))
    return by_mark.unionByName(by_length).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), _stripped(F.col("part")).alias("markdown"))
