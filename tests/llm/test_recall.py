"""Recall of the filters at several dimensions and of the trees at two levels and below large nodes."""

import numpy as np
import pytest

from quireflow.llm import minhash_dedup, vector_dedup
from quireflow.llm.common import mix64


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 5, 6, 8, 12, 16, 17, 24, 64, 1024])
def test_pairs_at_the_bound_share_a_filter(dim):
    draw = np.random.default_rng(dim)
    a = draw.normal(size=(400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        b = a
    else:
        side = draw.normal(size=a.shape)
        side -= (side * a).sum(1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        b = 0.9501 * a + (1 - 0.9501**2) ** 0.5 * side
    for size in (256, 2000):
        met = np.zeros(len(a), bool)
        for c in range(vector_dedup.CODES):
            code = vector_dedup.Code(dim, size, c)
            (r1, f1), (r2, f2) = code.decode(a), code.decode(b)
            met[np.intersect1d(r1.astype(np.int64) << 40 | f1, r2.astype(np.int64) << 40 | f2) >> 40] = True
        assert met.mean() >= 0.995, (dim, size)


def similar_signatures(draw, pairs, similarity):
    a = draw.integers(0, 1 << 32, (pairs, minhash_dedup.SIGNATURE), dtype=np.uint32)
    other = draw.integers(0, 1 << 32, a.shape, dtype=np.uint32)
    return a, np.where(draw.random(a.shape) < similarity, a, other)


def test_two_levels_of_trees_tie_pairs_at_the_bound(spark):
    a, b = similar_signatures(np.random.default_rng(3), 300, 0.8)
    both = np.concatenate([a, b])
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(both)], "cid long, signature binary")
    depth, trees = 2, minhash_dedup.plan_trees(5_000_000, 0.8)[1]
    assert minhash_dedup.plan_trees(5_000_000, 0.8)[0] >= 2
    ties = {tuple(sorted((r["u"], r["v"]))) for r in minhash_dedup.find_ties(classes, 0.8, depth, trees).collect()}
    alike = ((a[:, : minhash_dedup.SKETCH] & 255) == (b[:, : minhash_dedup.SKETCH] & 255)).sum(1) >= minhash_dedup.SKETCH_LEAST
    assert sum((i, i + 300) in ties for i in range(300)) >= alike.sum() >= 298


def test_large_nodes_branch_until_they_are_small():
    draw = np.random.default_rng(4)
    a, b = similar_signatures(draw, 1500, 0.8)
    sketch = (np.concatenate([a, b])[:, : minhash_dedup.SKETCH] & 255).astype(np.uint8)
    met = np.zeros(1500, bool)
    for rows in minhash_dedup._small_nodes(sketch, int(mix64(np.array([7], np.uint64))[0]) & 0xFFFFFF, leaf=64):
        assert len(rows) <= 64
        own = np.zeros(3000, bool)
        own[rows] = True
        met |= own[:1500] & own[1500:]
    assert met.mean() >= 0.998
