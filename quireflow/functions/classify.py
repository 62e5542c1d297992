"""Rule ladders that give a block its type; the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_math

#: The layout program's names for types (others are paragraphs).
ENGINE_TYPES = {
    "heading": "heading",
    "paragraph": "paragraph",
    "table": "table",
    "list": "list",
    "formula": "equation",
    "image": "figure",
    "picture": "figure",
    "figure": "figure",
    "caption": "caption",
    "footnote": "footer",
    "header": "header",
    "footer": "footer",
    "page-header": "header",
    "page-footer": "footer",
    "code": "code",
}
#: Parts of document labels, in the order in which they are looked for (others are paragraphs).
LABELS = {
    "text": "paragraph",
    "paragraph": "paragraph",
    "section_header": "heading",
    "title": "heading",
    "table": "table",
    "figure": "figure",
    "picture": "figure",
    "caption": "caption",
    "list_item": "list",
    "formula": "equation",
    "page_header": "header",
    "page_footer": "footer",
    "code": "code",
}
#: Which providers suit a dominant type, and all others.
SUGGESTED = {
    "academic": ["mineru", "docling", "marker"],
    "tabular": ["docling", "mineru", "marker"],
    "scientific": ["mineru", "marker", "docling"],
    "scanned": ["marker", "docling", "mineru"],
}
SUGGESTED_ELSE = ["marker", "docling", "markitdown"]
BLOCK_TYPES = ["paragraph", "table", "equation", "figure", "heading", "list", "code", "caption", "footer", "header", "other"]


def _starts(t: Column, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(t, F.lit(m))
    return out


def _table(t: Column) -> Column:
    """A line that begins with a bar and has another one."""
    return _starts(t, "|") & F.contains(F.substring(t, 2, 1 << 30), F.lit("|"))


def markdown_type(text: Column, code: bool = True) -> Column:
    """The ladder for Markdown paragraphs."""
    t = F.trim(text)
    out = F.when(_starts(t, "#"), "heading").when(_starts(t, "$$", "\\["), "equation")
    if code:
        out = out.when(_starts(t, "```"), "code")
    return out.when(_table(t), "table").when(_starts(t, "!["), "figure").when(_starts(t, "- ", "* ") | t.rlike(r"^\d+\."), "list").otherwise("paragraph")


def list_type(text: Column) -> Column:
    """The ladder of a content-list engine: equations first, no code, no numbered lists."""
    t = F.trim(text)
    return F.when(_starts(t, "$$", "\\["), "equation").when(_starts(t, "#"), "heading").when(_table(t), "table").when(_starts(t, "!["), "figure").when(_starts(t, "- ", "* "), "list").otherwise("paragraph")


def region_type(text: Column) -> Column:
    """The ladder for a region by its text: a short line that begins with a capital and has no full stop is a heading."""
    t = F.trim(text)
    short = (F.length(t) < 80) & t.rlike(r"^\p{Lu}") & ~F.endswith(t, F.lit("."))
    return F.when(t == "", "paragraph").when(_starts(t, "#") | short, "heading").when(has_math(t), "equation").when(_starts(t, "- ", "* ") | t.rlike(r"^\d+\.\s"), "list").when(_starts(t, "```"), "code").otherwise("paragraph")


def _known(names: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)


def engine_type(name: Column) -> Column:
    """The layout program's name for a type, by a fixed map; unknown names are paragraphs."""
    return F.coalesce(_known(ENGINE_TYPES, F.lower(name)), F.lit("paragraph"))


def label_type(label: Column) -> Column:
    """A document label's type: that of the first known part that it contains; unknown labels are paragraphs."""
    name, out = F.replace(F.lower(label), F.lit("-"), F.lit("_")), F.when(F.lit(False), "")
    for part, kind in LABELS.items():
        out = out.when(F.contains(name, F.lit(part)), kind)
    return out.otherwise("paragraph")


def content_type(kind: Column, text: Column) -> Column:
    """A content list's own type: text goes by its ladder, images are figures, display formulas equations."""
    kind = F.coalesce(kind, F.lit("text"))
    return F.when(kind == "text", list_type(text)).when(kind == "image", "figure").when(kind == "interline_equation", "equation").otherwise(kind)


def adapted_type(name: Column, unknown: str = "other") -> Column:
    """A provider's block type as one of BLOCK_TYPES; the segmenter takes unknown ones as paragraphs."""
    return F.when(name.isin(BLOCK_TYPES), name).otherwise(unknown)


def suggested_providers(dominant: Column) -> Column:
    """The providers that suit a document's dominant type, in order."""
    out = F.when(F.lit(False), F.array(F.lit("")))
    for kind, names in SUGGESTED.items():
        out = out.when(dominant == kind, F.array(*map(F.lit, names)))
    return out.otherwise(F.array(*map(F.lit, SUGGESTED_ELSE)))


def dominant_block_type(equation: Column, table: Column, density: Column, has_text: Column) -> Column:
    return F.when(equation, "equation").when(table, "table").when((density < 0.1) & ~has_text, "figure").otherwise("paragraph")


def dominant_document_type(pages: Column, math: Column, tables: Column, scanned: Column, columns: Column) -> Column:
    return F.when(pages == 0, "empty").when(math & tables, "academic").when(tables, "tabular").when(math, "scientific").when(scanned, "scanned").when(columns, "multi-column").otherwise("text-heavy")
