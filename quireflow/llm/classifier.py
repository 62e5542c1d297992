"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated.

Random indexing: every word and every word shape (which kinds of characters, length, whether it repeats the word
before) has a fixed sparse ternary index vector, drawn by hash. A word's context vector is the sum of the index
vectors of its neighbours over the whole corpus; words share `BUCKETS` hashed rows, so the table has a fixed size
whatever the corpus. A document's features are the mean context vector and the mean index vector of its words, and
its length. A network with one hidden layer is trained on a bounded sample of labelled rows (`sample`, the rows
of least hash); its temperature is fitted on a part of the sample that training did not see.

Defined results: null and empty texts have zero features and get a score like any other; without any labelled
training rows each score is 0.5; several labels of one id are averaged, null labels ignored; a null id is never
held out; repeated rows are scored each; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, mix64, pieces, span_hashes, tokens, trimmed

BUCKETS, DIM, NONZERO, SHAPES, SLABS, SAMPLE, HIDDEN = 16384, 32, 4, 4096, 128, 20_000, 32
THRESHOLD = 0.7


def _index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of n index vectors."""
    h = mix64(np.arange(n * NONZERO, dtype=np.uint64) + np.uint64(seed << 32))
    return (h % np.uint64(DIM)).astype(np.int64).reshape(n, NONZERO), ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float32).reshape(n, NONZERO) * 2 - 1


WORD_AT, WORD_SIGN = _index_vectors(BUCKETS, 1)
SHAPE_AT, SHAPE_SIGN = _index_vectors(SHAPES, 2)
SHAPE_VECTORS = np.zeros((SHAPES, DIM), np.float32)
np.add.at(SHAPE_VECTORS, (np.arange(SHAPES)[:, None], SHAPE_AT), SHAPE_SIGN)

#: One bit for each kind of character; marks that often stand for noise have bits of their own.
KIND = np.full(256, 1 << 15, np.uint16)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 4, 8
for _k, _c in enumerate(b".,!?|%$#*&-"):
    KIND[_c] = 1 << (4 + _k)


def word_codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of each word of all rows, and each row's first word."""
    begin, end, first = tokens(raw, at)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    h = span_hashes(LOWERED[raw], begin, end)
    repeat = np.r_[False, h[1:] == h[:-1]]
    repeat[first[:-1][first[:-1] < len(h)]] = False
    kinds = np.bitwise_or.reduceat(KIND[raw], begin).astype(np.uint64)
    shape = mix64(kinds * np.uint64(64) + np.minimum(end - begin, 15).astype(np.uint64) * np.uint64(2) + repeat) % np.uint64(SHAPES)
    return (h % np.uint64(BUCKETS)).astype(np.int64), shape.astype(np.int64), first


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vectors of all buckets (BUCKETS x DIM), each of length 1 or 0.

    Each task adds up its rows in one table, cut into slabs; the slabs are added up as they stream in. What comes
    to the driver has a fixed size.
    """
    schema = "slab int, sums binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIM)
        for _, raw, at in pieces(batches, text_col):
            word, shape, first = word_codes(raw, at)
            inner = np.ones(len(word), bool)  # has a word before it in its row
            inner[first[:-1][first[:-1] < len(word)]] = False
            here = np.flatnonzero(inner)
            for a, b in ((here, here - 1), (here - 1, here)):
                base = word[a] * DIM
                for k in range(NONZERO):
                    sums += np.bincount(base + WORD_AT[word[b], k], WORD_SIGN[word[b], k], BUCKETS * DIM)
                    sums += np.bincount(base + SHAPE_AT[shape[b], k], SHAPE_SIGN[shape[b], k], BUCKETS * DIM)
        if sums.any():
            cut = sums.astype(np.int32).reshape(SLABS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["slab", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slab, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int32 if len(x) == BUCKETS * DIM // SLABS * 4 else np.int64).astype(np.int64)
                sums[slab] = sums[slab] + x if slab in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slab", "sums"])

    rows = docs.select(F.col(text_col)).mapInArrow(trimmed(count), schema).repartition(SLABS, "slab").mapInArrow(trimmed(add), schema).collect()
    table = np.zeros((SLABS, BUCKETS * DIM // SLABS))
    for row in rows:
        table[row["slab"]] = np.frombuffer(bytes(row["sums"]), np.int64)
    table = table.reshape(BUCKETS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The pooled vectors of all rows: 2 * DIM + 1 numbers each."""
    word, shape, first = word_codes(raw, at)
    out = np.zeros((len(at) - 1, 2 * DIM + 1), np.float32)
    n = np.diff(first)
    full = np.flatnonzero(n)
    if len(full):
        out[full, :DIM] = np.add.reduceat(table[word], first[:-1][full], axis=0)
        out[full, DIM : 2 * DIM] = np.add.reduceat(SHAPE_VECTORS[shape], first[:-1][full], axis=0)
        out[full, : 2 * DIM] /= n[full, None]
        out[:, -1] = np.log1p(n) / 10
    return out


class Network:
    """Inputs, one hidden layer of tanh units, one logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        draw = np.random.default_rng(7)
        fit, rest = np.flatnonzero(~held), np.flatnonzero(held)
        if not len(fit):
            fit = np.arange(len(x))
        params = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = draw.permutation(fit)
            pace = rate * (1 - epoch / epochs)
            for k in range(0, len(order), 256):
                rows = order[k : k + 256]
                hidden = np.tanh(x[rows] @ params[0] + params[1])
                error = (_sigmoid(hidden @ params[2] + params[3]) - y[rows]) / len(rows)
                back = np.outer(error, params[2]) * (1 - hidden**2)
                grads = [x[rows].T @ back + decay * params[0], back.sum(0), hidden.T @ error + decay * params[2], np.array([error.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] -= pace * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.params, self.temperature = params, 1.0
        if len(rest):
            logits = self._logits(x[rest])
            loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y[rest] * logits / t)
            self.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logits((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """The context table of all docs, and the network; labels: doc_id, quality, training rows only."""
    table = context_table(docs)
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` narrow rows
    names = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in features(raw, at, names.value)], pa.binary())], ["id", "y", "x"])

    known = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == chosen["doc_id"]).select("id", "y", "text")
    pooled = known.mapInArrow(trimmed(pool), "id long, y int, x binary")
    rows = sorted(pooled.groupBy("id", "y").agg(F.min("x").alias("x")).collect())  # one row for an id that is repeated
    if not rows:
        return table, None
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).astype(np.float64)
    ids = np.array([r["id"] for r in rows], np.int64).astype(np.uint64)
    return table, Network(x, np.array([r["y"] for r in rows], float), mix64(ids) % np.uint64(5) == 0)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None]) -> DataFrame:
    """doc_id, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in pieces(batches, "text"):
            table, net = shared.value
            p = net.score(features(raw, at, table).astype(np.float64)) if net else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def training_labels(spark, sf_dir: str) -> DataFrame:
    """Labels of the rows that may be learned from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 4) != 2).select("doc_id", "quality")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    shared = spark.sparkContext.broadcast(fit(docs, training_labels(spark, sf_dir)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in pieces(batches, "text"):
            table, net = shared.value
            good = net.score(features(raw, at, table).astype(np.float64)) >= THRESHOLD if net else np.ones(part.num_rows, bool)
            yield part.filter(pa.array(good)).select(names)

    return docs.mapInArrow(trimmed(run), docs.schema)
