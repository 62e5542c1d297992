"""Boxes (x0, y0, x1, y1, y downwards) as Column expressions; a box is a prefix of four column names or a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side(box: Column, name: str) -> Column:
    return box[name]


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its corners in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Shared area by united area; 0 if that is not positive."""
    union = area(a) + area(b) - shared_area(a, b)
    return F.when(union > 0, shared_area(a, b) / union).otherwise(0.0)


def share_of(block: Column, region: Column) -> Column:
    """The part of the block's area that lies in the region; 0 for a block without area."""
    return F.when(area(block) > 0, shared_area(block, region) / area(block)).otherwise(0.0)


def density(text: Column, has_text: Column) -> Column:
    return F.when(has_text, F.least(F.length(text) / 8000.0, F.lit(1.0))).otherwise(0.0)


def stacked_box(idx: Column, height: float = 50.0, width: float = 612.0) -> Column:
    """The made-up box of a paragraph that has none: one strip below the other."""
    return F.struct(F.lit(0.0).alias("x0"), (idx * height).alias("y0"), F.lit(width).alias("x1"), ((idx + 1) * height).alias("y1"))
