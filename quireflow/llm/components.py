"""Connected components of a graph of links, by large-star and small-star rounds on DataFrames.

Nothing is collected: each round is two aggregations by node (partial sums before the shuffle, so that a node with
very many links is met by partial minima) and two joins, written to the shared folder. Before the rounds, every task
contracts the links it holds to a spanning forest. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b: each node that isn't the smallest of its component, and that smallest one."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (jump := new[new]).tolist() != new.tolist() if len(new) < 64 else not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def contract(links: DataFrame) -> DataFrame:
    """Links (u, v) with a spanning forest of each task's links in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[pa.RecordBatch] = []

        def fold(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a = np.concatenate([u, *[b.column(0).to_numpy() for b in held]])
            b = np.concatenate([v, *[b.column(1).to_numpy() for b in held]])
            held.clear()
            return forest(a, b)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > max(1 << 18, len(u)):
                u, v = fold(u, v)
        if held:
            u, v = fold(u, v)
        for k in range(0, len(u), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 18)]), pa.array(v[k : k + (1 << 18)])], ["u", "v"])

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of a link, root being the smallest node that it reaches; links: u, v (long)."""
    now = materialize(contract(links.where("u <> v")).distinct(), "links")
    last = None
    while True:
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.col("u").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == last or not state[0]:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = now, materialize(moved.where("u <> v").distinct(), "links")
        release(before)
    own = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return materialize(own.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")), "components")


def reach(linked: np.ndarray) -> np.ndarray:
    """For a square boolean matrix: the smallest index that each row reaches."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            open_ = np.flatnonzero(root < 0)
            if not len(open_):
                break
            front = open_[linked[np.ix_(front, open_)].any(0)]
            root[front] = i
    return root
