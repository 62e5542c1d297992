"""Licence scans with DataFrame functions only.

Texts and templates are read as runs of a-z and 0-9 after lower-casing, and as shingles of `WIDTH` words (of all its
words, for a shorter template). Templates fall into classes by length: a class's stride is the least power of two of
at least 5/4 of its templates' words. For each class a text is cut into windows of two strides that overlap by half, so
that a template's copy lies in one window even if it is stretched by a quarter. A window is the set of its shingles that
belong to templates of the class. MinHash bands of one value retrieve templates: a window with `least` of a template's
shingles has no more than its other places as further members, which bounds the Jaccard similarity from below, and a
class has as many bands as make it meet each of its templates with probability `RECALL` at that bound, whatever else
stands in the window. Retrieved pairs are verified exactly: the share of the template's distinct shingles in the window
must be at least `least`.

Defined results: null and empty texts match nothing; a template that occurs several times in a text gives one row,
the one with most shingles, then the first; rows that repeat an id are scanned each and give one row together; a null
id is a group of its own; an empty table gives no rows; further columns are not looked at. Templates without words
are refused, as are more than VOCABULARY shingles (they are sent to all tasks): scan for more in several calls.
"""

from __future__ import annotations

import re
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WIDTH, LEAST, VOCABULARY, RECALL = 5, 0.8, 100_000, 1 - 1e-7

#: Notices by which texts state their licence.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "reserved": "All rights reserved.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str) -> tuple[int, list[str]]:
    """The shingles' width and the shingles in order, joined by spaces."""
    w = words(text)
    width = min(WIDTH, len(w))
    if not width:
        raise ValueError("a template without words")
    return width, [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]


def stride_of(text: str) -> int:
    """The stride of a template's class."""
    return 1 << (ceil(1.25 * len(words(text))) - 1).bit_length()


def bands_of(texts: list[str], least: float) -> int:
    """How many bands a class of templates needs, by the least similarity of a window to a template that it holds."""
    alike = 1.0
    for text in texts:
        width, shingles = template_shingles(text)
        n, stride = len(set(shingles)), stride_of(text)
        held = ceil(least * n - 1e-9)
        others = sum(2 * stride - held * (w == width) for w in {template_shingles(t)[0] for t in texts})
        alike = min(alike, held / (n + max(0, others)))
    return ceil(log(1 - RECALL) / log(1 - alike)) if alike < 1 else 1


def known_shingles(w: Column, width: int, vocabulary: list[int], heads: list[list[str]]) -> Column:
    """Where (word number) in an array of words shingles of the vocabulary are, and their hashes.

    heads: the words that shingles begin with, and their second words; they rule most places out before hashing.
    """
    last = F.size(w) - width + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def known(i: Column) -> Column:
        ok = F.get(w, i - 1).isin(heads[0])
        if width > 1:
            ok = ok & F.get(w, i).isin(heads[1])
        return ok & F.xxhash64(F.slice(w, i, width)).isin(vocabulary)

    return F.transform(F.filter(at, known), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice(w, i, width)).alias("h")))


def minima(hashes: Column, bands: Column) -> Column:
    """The least value of each band's hash over a set."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each document and template that it holds: id_col, license, n_shingles, n_found, word_at.

    word_at: where the window begins in which it was found (a word's number, from 0).
    """
    spark = docs.sparkSession
    rows = [(name, stride_of(text), width, x) for name, text in templates.items() for width, s in [template_shingles(text)] for x in set(s)]
    if len(rows) > VOCABULARY:
        raise ValueError("too many template shingles to send to all tasks")
    by_stride = {s: [t for t in templates.values() if stride_of(t) == s] for s in {stride_of(t) for t in templates.values()}}
    bands = spark.createDataFrame([(s, bands_of(own, least)) for s, own in by_stride.items()], "stride int, bands int")
    parts = spark.createDataFrame(rows, "license string, stride int, width int, shingle string").withColumn("h", F.xxhash64(F.split("shingle", " ")))
    vocabulary, heads = {}, {}
    for r in parts.select("width", "shingle", "h").distinct().collect():
        vocabulary.setdefault(r["width"], set()).add(r["h"])
        for k, word in enumerate(r["shingle"].split()[:2]):
            heads.setdefault(r["width"], [set(), set()])[k].add(word)
    whole = parts.groupBy("license", "stride").agg(F.collect_set("h").alias("shingles")).join(bands, "stride")
    wanted = whole.select("license", "stride", "shingles", F.posexplode(minima(F.col("shingles"), F.col("bands"))).alias("band", "value"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    hits = let(read, lambda w: F.concat(*[known_shingles(w, width, sorted(own), [sorted(x) for x in heads[width]]) for width, own in sorted(vocabulary.items())]))
    seen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.explode(hits).alias("x")).select("id", "row", "x.*")
    keyed = seen.join(F.broadcast(parts.select("stride", "h").distinct()), "h")
    last = F.floor(F.col("at") / F.col("stride"))
    placed = keyed.withColumn("window", F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last)))
    windows = placed.groupBy("id", "row", "stride", "window").agg(F.collect_set("h").alias("own"))  # two strides of shingles at most
    banded = windows.join(F.broadcast(bands), "stride").select("id", "row", "stride", "window", "own", F.posexplode(minima(F.col("own"), F.col("bands"))).alias("band", "value"))
    met = banded.join(F.broadcast(wanted), ["stride", "band", "value"])
    found = F.size(F.array_intersect("own", "shingles")).alias("n_found")
    checked = met.select("id", "license", "stride", "window", F.size("shingles").alias("n_shingles"), found).where(F.col("n_found") >= least * F.col("n_shingles"))
    best = checked.groupBy("id", "license", "stride", "n_shingles").agg(F.min(F.struct((-F.col("n_found")).alias("less"), "window")).alias("b"))
    return best.select(F.col("id").alias(id_col), "license", F.col("n_shingles").cast("long"), (-F.col("b.less")).cast("long").alias("n_found"), (F.col("b.window") * F.col("stride")).cast("long").alias("word_at"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_templates() -> str:
    rows = [(name, stride_of(text), width, x) for name, text in TEMPLATES.items() for width, s in [template_shingles(text)] for x in sorted(set(s))]
    return ", ".join("('{}', {}, {}, '{}')".format(*r) for r in rows)


OP3_SQL = f"""
WITH t(license, stride, width, shingle) AS (VALUES {_sql_templates()}),
n AS (SELECT license, count(*) AS n_shingles FROM t GROUP BY license),
d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
s AS (
  SELECT doc_id, k, w.width, unnest(range(len(d.w) - w.width + 1)) AS pos, unnest(list_transform(range(1, len(d.w) - w.width + 2), lambda i: array_to_string(d.w[i:i + w.width - 1], ' '))) AS shingle
  FROM d CROSS JOIN (SELECT DISTINCT width FROM t) w WHERE len(d.w) >= w.width
), h AS (SELECT s.doc_id, s.k, s.pos, t.license, t.stride, t.shingle FROM s JOIN t ON s.width = t.width AND s.shingle = t.shingle),
w AS (SELECT *, unnest(range(greatest(pos // stride - 1, 0), pos // stride + 1)) AS "window" FROM h),
f AS (SELECT doc_id, k, license, stride, "window", count(DISTINCT shingle) AS n_found FROM w GROUP BY ALL)
SELECT doc_id, license, n_shingles, max(n_found) AS n_found, arg_min("window", -n_found * 1000000000 + "window") * stride AS word_at
FROM f JOIN n USING (license) WHERE n_found >= {LEAST} * n_shingles GROUP BY doc_id, license, stride, n_shingles
"""
