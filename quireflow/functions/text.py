"""Text predicates and scalar functions as Column expressions; Unicode normalisation and entities as Pandas UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs of mathematics, letters of Turkish, how refusals begin, words before a figure's number.
LATEX_MARKS = ["\\frac", "\\int", "\\sum", "\\prod", "\\lim", "\\alpha", "\\beta", "\\gamma", "\\delta", "\\theta", "\\partial", "\\nabla", "\\infty", "\\sqrt"]
MATH_SIGNS = "∑∫∂∇≈≠±∞αβγδεθλμσωπΣΔΩ"
MATH_WORDS = r"\\\\frac|\\\\int|\\\\sum|E\s*=\s*mc"
TURKISH = "çğıöşüÇĞİÖŞÜ"
REFUSALS = ["i cannot", "i can't", "sorry", "as an ai"]
FIGURE_WORDS = r"Figure|Fig\.?|Diagram|Chart|Illustration|Schematic"
ENTITIES = ["&amp;", "&lt;", "&gt;", "&quot;", "&#"]
OTHER_THAN_ASCII = r"[^\x00-\x7F]"


def drop_replacement(t: Column) -> Column:
    """Without U+FFFD."""
    return F.replace(t, F.lit("�"), F.lit(""))


def only_where(need: Column, t: Column, function) -> Column:
    """function(t) where it is needed, else t; other rows go to the Python worker as nulls."""
    return F.coalesce(function(F.when(need, t)), t)


@F.pandas_udf(T.StringType())
def _plain(t: pd.Series) -> pd.Series:
    drop = re.compile("[\u200b-\u200f\u202a-\u202e\u2060\ufeff]")
    return t.map(lambda s: drop.sub("", unicodedata.normalize("NFKC", s)).replace("\u00ad", ""), na_action="ignore")


def plain_form(t: Column) -> Column:
    """NFKC without zero-width and direction marks and soft hyphens; ASCII texts pass as they are."""
    return only_where(t.rlike(OTHER_THAN_ASCII), t, _plain)


@F.pandas_udf(T.StringType())
def _composed(t: pd.Series) -> pd.Series:
    return t.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def composed_form(t: Column) -> Column:
    """NFC."""
    return only_where(t.rlike(OTHER_THAN_ASCII), t, _composed)


@F.pandas_udf(T.StringType())
def _unescaped(t: pd.Series) -> pd.Series:
    return t.map(html.unescape, na_action="ignore")


def unescape_html(t: Column) -> Column:
    """Entities resolved, if one of ENTITIES is there."""
    need = F.lit(False)
    for token in ENTITIES:
        need = need | F.contains(t, F.lit(token))
    return only_where(need, t, _unescaped)


@F.pandas_udf(T.BooleanType())
def _from_the_right(t: pd.Series) -> pd.Series:
    return t.map(lambda s: s is not None and any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in s)).astype(bool)


def is_rtl(t: Column) -> Column:
    """Whether one of the first 500 characters is written from right to left."""
    head = F.substring(t, 1, 500)
    return _from_the_right(F.when(head.rlike(OTHER_THAN_ASCII), head))


def drop_html_rests(t: Column) -> Column:
    """Superscripts and subscripts that hold nothing but an ampersand or nothing go; entities are resolved.

    An ampersand that begins no entity is written as one first, so that it comes back as it was.
    """
    t = F.regexp_replace(t, r"(?i)<sup>\s*&(?:amp;)?\s*</sup>", "")
    t = F.regexp_replace(t, r"(?i)<(sup|sub)>\s*</\1>", "")
    return unescape_html(F.regexp_replace(t, r"&(?!(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,8});)", "&amp;"))


def strip(t: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean_text(t: Column) -> Column:
    """A block's text: marks and rests dropped, blanks collapsed, stripped."""
    return strip(F.regexp_replace(drop_html_rests(plain_form(drop_replacement(t))), r"[ \t]{2,}", " "))


def fix_whitespace(t: Column) -> Column:
    """Three and more newlines become two, then blanks at line ends go; one newline at the end."""
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?m)[ \t]+$", "")
    return F.concat(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit("\n"))


def merge_broken_sentences(t: Column) -> Column:
    """A line that goes on in lower case joins the line before, unless that is empty or ends a sentence, label or row.

    For texts without blanks at line ends (as of fix_whitespace()).
    """
    return F.regexp_replace(t, r"(?<=[^\n:.!?|])[^\S\n]*\n[^\S\n]*(?=\p{Ll})", " ")


def sanitize_latex(t: Column) -> Column:
    """White space beside a dollar sign becomes one blank."""
    return F.regexp_replace(F.regexp_replace(t, r"\$\s+", r"\$ "), r"\s+\$", r" \$")


def has_equation(t: Column) -> Column:
    found = F.regexp_count(t, F.lit(r"\$")) >= 2
    for mark in LATEX_MARKS:
        found = found | F.contains(t, F.lit(mark))
    return F.coalesce(found, F.lit(False))


def has_table(t: Column) -> Column:
    """At least three lines with two or more bars, or at least three with two or more tabs."""
    rows = lambda mark: F.size(F.filter(F.split(t, "\n"), lambda x: F.regexp_count(x, F.lit(mark)) >= 2)) >= 3
    return F.coalesce(rows(r"\|") | rows(r"\t"), F.lit(False))


def has_math(t: Column) -> Column:
    return F.coalesce(t.rlike(f"[{MATH_SIGNS}]") | F.contains(t, F.lit("$$")) | F.contains(t, F.lit("\\[")) | t.rlike(MATH_WORDS), F.lit(False))


def language(t: Column) -> Column:
    """tr, en or null by the letters of the first 2000 characters."""
    head = F.substring(t, 1, 2000)
    letters, latin = F.regexp_count(head, F.lit(r"\p{L}")), F.regexp_count(head, F.lit("[A-Za-z]"))
    return F.when(F.regexp_count(head, F.lit(f"[{TURKISH}]")) > 5, "tr").when((letters > 0) & (latin > 0.9 * letters), "en")


def latin_share(t: Column) -> Column:
    """The share of a-z among all characters (null for an empty text)."""
    return F.round(F.regexp_count(t, F.lit("[A-Za-z]")) / F.nullif(F.length(t), F.lit(0)), 3)


def word_set(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def heading_level(t: Column) -> Column:
    """h1 to h6 by the leading marks, h2 without."""
    marks = F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))
    return F.concat(F.lit("h"), F.when(marks > 0, marks).otherwise(2).cast("string"))


def heading_text(t: Column) -> Column:
    return F.regexp_replace(t, r"^#{1,6}\s*", "")


def figure_reference(t: Column) -> Column:
    """The first reference to a numbered figure, else the empty text."""
    return F.regexp_extract(t, rf"(?i)((?:{FIGURE_WORDS})\s*\d+[.-]?\d*)", 1)


def caption_ok(t: Column) -> Column:
    """Long enough, of three words, and no refusal."""
    ok = (F.length(t) >= 10) & (F.regexp_count(t, F.lit(r"\S+")) >= 3)
    for start in REFUSALS:
        ok = ok & ~F.startswith(F.lower(t), F.lit(start))
    return F.coalesce(ok, F.lit(False))


def out_of_memory(t: Column) -> Column:
    t = F.lower(t)
    return F.coalesce(F.contains(t, F.lit("cuda")) & (F.contains(t, F.lit("out of memory")) | F.contains(t, F.lit("alloc"))), F.lit(False))


def duration(seconds: Column) -> Column:
    """mm:ss, h:mm:ss from an hour on, ??:?? for none or negative."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.concat_ws(":", two(F.floor(s / 60) % 60), two(s % 60))
    long_ = F.concat_ws(":", F.floor(s / 3600).cast("string"), minutes)
    return F.when(seconds.isNull() | (seconds < 0), "??:??").when(s >= 3600, long_).otherwise(minutes)


def safe_name(path: Column) -> Column:
    """A file's name without folders and odd characters, 200 characters at most."""
    name = F.substring(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._-]", ""), 1, 200)
    return F.when(F.coalesce(name, F.lit("")) == "", "input.pdf").otherwise(name)


def job_id_ok(t: Column) -> Column:
    return F.coalesce(t.rlike("^job-[a-f0-9]{8}$"), F.lit(False))


def digest_ok(t: Column) -> Column:
    return F.coalesce(t.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def image_link(t: Column) -> Column:
    """alt and path of the first Markdown image; the alt text defaults to figure."""
    alt = F.regexp_extract(t, r"!\[([^\]]*)\]\(([^)]*)\)", 1)
    return F.struct(F.when(alt == "", "figure").otherwise(alt).alias("alt"), F.regexp_extract(t, r"!\[([^\]]*)\]\(([^)]*)\)", 2).alias("path"))


def table_hint(cells: Column) -> Column:
    """What stands for a table: its first row's cells, 200 characters at most; [table] without a row."""
    named = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
    return F.coalesce(F.substring(F.concat(F.lit("[table: "), named, F.lit("]")), 1, 200), F.lit("[table]"))


def table_markdown(rows: Column) -> Column:
    """A Markdown table from rows of cells, with a rule after the first."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, table_row)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def table_row(cells: Column) -> Column:
    """A Markdown table's row; null cells are empty."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def keywords(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")


def image_header(content: Column) -> Column:
    """Whether bytes are a JPEG or PNG of some size."""
    return (F.octet_length(content) >= 200) & F.hex(F.substring(content, 1, 2)).isin("FFD8", "8950")
