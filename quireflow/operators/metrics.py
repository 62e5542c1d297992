"""Metrics that hold one Markdown text against another."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def character_fidelity(actual: Column, expected: Column) -> Column:
    """The share of the expected text's characters that stand at the same place, white space folded; 0 without a text."""
    fold = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    a, b = F.split(fold(actual), ""), F.split(fold(expected), "")
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False))), lambda x: x))
    shared = same / F.greatest(F.length(fold(expected)), F.lit(1))
    return F.when(F.coalesce(expected, F.lit("")) == "", 0.0).when(fold(actual) == fold(expected), 1.0).otherwise(shared)


def line_order(actual: Column, expected: Column) -> Column:
    """The share of the expected text's lines, blank ones aside, that stand at the same place; 0 without lines."""
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S"))
    a, b = lines(actual), lines(expected)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(F.size(b) == 0, 0.0).otherwise(same / F.size(b))


def count_ratio(actual: Column, expected: Column, pattern: str) -> Column:
    """How alike the numbers of matches are: smaller by larger; without any expected 1 if there are none, else 0."""
    a, b = F.regexp_count(actual, F.lit(pattern)), F.regexp_count(expected, F.lit(pattern))
    return F.when(b == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


#: What counts for tables and for equations.
BARS, FORMULAS = r"\|", r"(?s)\$\$.*?\$\$|\$.*?\$"


@F.pandas_udf(T.StructType([T.StructField("added", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("same", T.LongType())]))
def line_changes(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """How many lines were added, removed and kept."""
    rows = []
    for a, b in zip(old.fillna(""), new.fillna(""), strict=True):
        a, b = a.split("\n"), b.split("\n")
        same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        rows.append((len(b) - same, len(a) - same, same))
    return pd.DataFrame(rows, columns=["added", "removed", "same"])
