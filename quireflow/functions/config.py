"""Settings, engine boxes and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def override(t: Column) -> Column:
    """key and value of KEY=VALUE; null without an equals sign."""
    at = F.instr(t, "=")
    return F.when(at > 0, F.struct(F.trim(F.substr(t, F.lit(1), at - 1)).alias("key"), F.trim(F.substr(t, at + 1)).alias("value")))


def layered(*maps: Column) -> Column:
    """One map of settings; later maps win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(F.map_filter(out, _not_in(m)), m)
    return out


def _not_in(m: Column):
    return lambda k, v: ~F.array_contains(F.map_keys(m), k)


def numbered_keys(m: Column) -> Column:
    """A map's entries whose keys are integers, by number."""
    entries = F.filter(F.map_entries(m), lambda e: e["key"].rlike(r"^\s*-?\d+\s*$"))
    return F.transform(entries, lambda e: F.struct(F.trim(e["key"]).cast("int").alias("page"), e["value"].alias("value")))


def engine_page(page: Column) -> Column:
    """A page number as engines give it: none and 0 mean the first."""
    return F.greatest(F.coalesce(page, F.lit(1)), F.lit(1))


def engine_side(*values: Column) -> Column:
    """The first of several values that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(0.0))


def fitted_size(width: Column, height: Column, most: int = 1024) -> Column:
    """Width and height scaled down so that the longer side is at most `most`."""
    ratio = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.floor(width * ratio).cast("int").alias("width"), F.floor(height * ratio).cast("int").alias("height"))
