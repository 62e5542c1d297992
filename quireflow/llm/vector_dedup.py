"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form structured random product codes: the (randomly rotated) space is cut into two blocks, each with
its own random code words, and every pair of code words is a direction. A vector is list-decoded to all directions
whose inner product with it exceeds a bound, by sorted inner products and without looking at each pair. The bound is
set from the dimension so that a vector passes `FILTERS` directions of each of `CODES` independent codes on average;
vectors with a cosine of 0.95 then share about 40 % of them (at least 4 in 999 of 1000 random pairs at 0.951 in 64
dimensions). Vectors are joined on filters and verified in double precision. Up to `FEW` dimensions a block would be too
small for evenly spread directions: there the code has one block, and only so many directions that caps stay wider than
a cosine of `WIDEST`; in one or two dimensions all vectors of a length share one filter.

Equal vectors are one class, compared once. A filter's members give a spanning forest of their verified links and not
all pairs; links are counted afterwards in each component, in blocks of at most `BLOCK` classes, so that a large group
is spread over many tasks and its pairs are never rows.

Defined results: null or zero vectors, and those with null or non-finite components, have no links; vectors of
different lengths are never linked; rows that repeat a vec_id are vectors of their own; a null vec_id counts as the
largest; an empty table gives no rows; labels and further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components, reach
from .common import materialize, trimmed

COSINE, FILTERS, CODES, PARTS, BLOCK, DIRECT, FEW, WIDEST = 0.95, 12, 8, 2, 1024, 2048, 16, 0.85


def cap_bound(dim: int, directions: float, filters: float) -> float:
    """The inner product that `filters` of so many random directions exceed on average."""
    x = np.linspace(-1, 1, 200_001)
    if dim < 3:
        return -2.0
    density = np.exp(lgamma(dim / 2) - lgamma((dim - 1) / 2) - 0.5 * np.log(np.pi) + (dim - 3) / 2 * np.log(np.maximum(1 - x * x, 1e-300)))
    tail = np.cumsum(density[::-1])[::-1] * (x[1] - x[0])
    return float(x[np.searchsorted(-tail, -filters / directions)])


class Code:
    """The product code of a dimension: `size` code words in each of its blocks (one block at few dimensions)."""

    def __init__(self, dim: int, size: int, seed: int = 11, filters: float = FILTERS):
        draw = np.random.default_rng([seed, dim, size])
        parts = PARTS if dim > FEW else 1
        if dim < 3:
            size = 1
        elif parts == 1:
            size = min(size, 4096)
            while size > 16 and cap_bound(dim, size, filters) > WIDEST:
                size //= 2
        self.turn = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
        self.cuts = [dim * k // parts for k in range(parts + 1)]
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            w = draw.normal(size=(size, b - a))
            self.words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / parts**0.5)
        self.size, self.bound = size, cap_bound(dim, size**parts, min(filters, size**parts))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filters of all (vector, direction) with an inner product of at least the bound."""
        v = unit @ self.turn
        s = [v[:, a:b] @ w.T for (a, b), w in zip(zip(self.cuts, self.cuts[1:], strict=False), self.words, strict=True)]
        if len(s) == 1:
            return np.nonzero(s[0] >= self.bound)
        order = np.argsort(-s[1], axis=1)
        last = np.take_along_axis(s[1], order, axis=1)
        rows, found = [], []
        for i in range(len(v)):
            ok = np.flatnonzero(s[0][i] >= self.bound - last[i, 0])
            if not len(ok):
                continue
            n = np.searchsorted(-last[i], s[0][i][ok] - self.bound, "right")
            ends = np.cumsum(n)
            k = np.arange(ends[-1]) - np.repeat(ends - n, n)
            found.append(np.repeat(ok, n) * self.size + order[i, k])
            rows.append(np.full(ends[-1], i))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def code_size(vectors: int) -> int:
    """Code words in a block, so that a direction has less than one vector on average."""
    return int(min(1 << 16, max(256, np.ceil((64 * vectors) ** (1 / PARTS)))))


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix, each of length 1."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else tiny or huge vectors lose their norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    col = batch.column(batch.schema.get_field_index(column))
    n = np.diff(col.offsets.to_numpy())
    for size in np.unique(n):
        yield batch if (n == size).all() else batch.filter(pa.array(n == size))


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first `keys` columns, cut so that no run of equal keys is split."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, row: int) -> tuple:
        return tuple(b.column(i)[row].as_py() for i in range(keys))

    for b in batches:
        if not b.num_rows:
            continue
        end = key(b, b.num_rows - 1)
        if held and key(held[0], 0) == end == key(b, 0):
            held.append(b)
            continue
        same = np.ones(b.num_rows, bool)
        for i in range(keys):
            same &= np.asarray(b.column(i).to_numpy(zero_copy_only=False) == end[i])
        cut = b.num_rows - int(same.sum())
        yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches(max_chunksize=None)[0] if held or cut else b.slice(0, 0)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def find_links(classes: DataFrame, size: int, cosine: float = COSINE) -> DataFrame:
    """Links (u, v) that connect all classes which verified pairs connect; classes: cid, vec."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], Code] = {}
        for whole in batches:
            for b in _by_length(whole, "vec"):
                step = max(16, (1 << 22) // size)  # bounds the inner products held at once
                for k in range(0, b.num_rows, step):
                    part = b.slice(k, step)
                    unit = _matrix(part.column(1))
                    dim = unit.shape[1]
                    for c in range(CODES):
                        if (c, dim) not in codes:
                            codes[c, dim] = Code(dim, size, c)
                        rows, found = codes[c, dim].decode(unit)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array((found + c * size**PARTS).astype(np.int64)), part.column(0).take(pa.array(rows))], ["dim", "filter", "cid"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches, 2):
            if b.num_rows < 2:
                continue
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for part in _by_length(b, "vec"):
                key, cid, unit = part.column(1).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3))
                small = []
                for i, j in _runs(key):
                    if j - i <= 12:
                        small.append((i, j))
                        continue
                    starts = range(i, j, DIRECT)
                    for x in starts:  # all pairs of stretches of a long run
                        for y in starts if j - i > DIRECT else [x]:
                            if y < x or (y == x and j - i > DIRECT and len(starts) > 1):
                                continue
                            rows = np.r_[x : min(x + DIRECT, j)] if y == x else np.r_[x : min(x + DIRECT, j), y : min(y + DIRECT, j)]
                            root = reach(unit[rows] @ unit[rows].T >= cosine)
                            tied = root != np.arange(len(rows))
                            out.append((cid[rows[tied]], cid[rows[root[tied]]]))
                for step in range(1, max((j - i for i, j in small), default=1)):
                    left = np.flatnonzero(key[step:] == key[:-step])
                    left = left[np.einsum("ij,ij->i", unit[left], unit[left + step]) >= cosine] if len(left) else left
                    out.append((cid[left], cid[left + step]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["u", "v"])

    entries = classes.select("cid", "vec").mapInArrow(trimmed(decode), "dim int, filter long, cid long")
    shared = entries.withColumn("m", F.count("*").over(W.partitionBy("dim", "filter"))).where("m > 1")  # vectors travel only to these
    entries = shared.join(classes.select("cid", "vec"), "cid").select("dim", "filter", "cid", "vec")
    return entries.repartition("dim", "filter").sortWithinPartitions("dim", "filter", "cid").mapInArrow(trimmed(verify), "u long, v long")


def count_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(cid, links): rows linked with a class's vector, without its own class; members: root, cid, vec, n, size."""
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("cid"), blocks)
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cid", "n", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 3):
            ids, sums = [], []
            for b in _by_length(batch, "vec"):
                root, x, y, own, cid, n, unit = *(b.column(i).to_numpy() for i in range(6)), _matrix(b.column(6))
                edge = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    linked = unit[i:j] @ unit[i:j].T >= cosine
                    np.fill_diagonal(linked, False)
                    if x[i] != y[i]:  # pairs within a block are counted where both are that block
                        linked &= own[i:j][:, None] != own[i:j][None, :]
                    ids.append(cid[i:j])
                    sums.append(linked @ n[i:j])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums).astype(np.int64))], ["cid", "links"])

    return spread.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(trimmed(count), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = materialize(rows.where(good).groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("cid"), "vec", "least", "n"), "classes")
    links = find_links(classes, code_size(classes.count()), cosine)
    roots = components(links)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = materialize(roots.withColumnRenamed("node", "cid").join(sizes, "root").join(classes, "cid").select("root", "cid", "vec", "n", "least", "size"), "members")
    lowest = members.groupBy("root").agg(F.min("least").alias("lowest"))
    known = members.select("cid", "root").join(lowest, "root").join(count_links(members, cosine), "cid").select("cid", "lowest", "links")
    told = classes.join(known, "cid", "left").select(F.col("vec").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    ok = rows.where(good).join(told, F.col("vec") == F.col("same")).select("id", "n_links", "component_id")
    bad = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return ok.unionByName(bad).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), r AS (SELECT vec_id AS u, vec_id AS c FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.c)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = e.vec_id
"""
