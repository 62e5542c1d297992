"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets are one class. Each class has `SIGNATURE`
minwise hash values, the tokens of the join. In each of `trees` independent trees a class branches by tokens: at a
node it follows each of its tokens with probability 1 / (similarity * SIGNATURE), chosen by a hash of node and token,
so that similar classes choose the same branches; after `depth` branchings it is in small nodes. A node's members are
compared exhaustively by short sketches, and classes that may be similar enough are tied. depth follows the number
of classes (unrelated sets part by a factor of `SPREAD` at least a level); trees follow from it, so that a pair at the
similarity bound meets in some tree with probability RECALL. Nodes that are larger than `LEAF` for lack of varied
tokens branch on inside the task.

Ties only say which sets to look at: connected by them, classes form candidate groups, whose full sets are compared
exactly, in chunks of at most `CHUNK` classes. Where a group of several chunks hasn't become one, all that lies
outside its largest part is compared with all of the group, chunk by chunk. No pair of classes is ever a row: chunks
give spanning forests of their links.

Defined results: words are runs of bytes other than white space, A-Z lower-cased; a text with fewer words than a
shingle has its whole sequence as its one shingle; texts without words, and null, have an empty set and no links;
ids may repeat: rows with equal ids are documents of their own; a null id counts as the largest; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWERED, kept, materialize, mix64, pieces, span_hashes, tokens, trimmed
from .components import components, reach
from .vector_dedup import whole_runs

SIGNATURE, SKETCH, SKETCH_LEAST, SPREAD, RECALL, LEAF, CHUNK, BRANCH = 64, 32, 14, 100, 0.99999, 4096, 192, 1.25
_MULTIPLY = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each row, ascending, and the rows' offsets."""
    begin, end, first = tokens(raw, at)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    h = span_hashes(LOWERED[raw], begin, end)
    words = np.diff(first)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), count)
    start = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(words, width)[row]
    total = size.astype(np.uint64)
    for k in range(width):
        more = np.flatnonzero(size > k)
        total[more] = mix64(total[more] * np.uint64(0x9E3779B97F4A7C15) + h[start[more] + k])
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.r_[True, (total[1:] != total[:-1]) | (row[1:] != row[:-1])]
    total, row = total[new], row[new]
    return total, np.searchsorted(row, np.arange(len(words) + 1))


def _digests(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each row's set: two sums of mixed members, which no order disturbs."""
    out = []
    for salt in (1, 2):
        mixed = mix64(sets + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64)))
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)]
        out.append(total[at[1:]] - total[at[:-1]])
    return [x.tobytes() for x in np.stack([*out], 1)]


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    """id, n (set size), digest, signature (SIGNATURE 32-bit values), key (binary, as given) of each row."""
    key = F.lit(None).cast("binary") if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in pieces(batches, "text"):
            sets, rows = shingles(raw, at, width)
            full = np.flatnonzero(np.diff(rows))
            sig = np.zeros((part.num_rows, SIGNATURE), np.uint32)
            for k in range(SIGNATURE if len(full) else 0):
                sig[full, k] = np.minimum.reduceat(sets * _MULTIPLY[k], rows[:-1][full]) >> np.uint64(16) & np.uint64(0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(rows)), pa.array(_digests(sets, rows), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), part.column(1)], ["id", "n", "digest", "signature", "key"])

    return docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "id long, n long, digest binary, signature binary, key binary")


def plan_trees(classes: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """How deep and how many: a path is shared down to each level as in a branching process."""
    depth = max(1, ceil(log(max(2, classes) / LEAF * SPREAD, SPREAD)))
    meet = 1.0
    for _ in range(depth):
        meet = 1 - exp(-BRANCH * similarity * meet)
    return depth, max(1, ceil(log(1 - recall) / log(1 - meet)))


def _branch(rows: np.ndarray, path: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The branches that rows take from their nodes: rows again, and the new nodes."""
    bound = np.uint64(int(BRANCH / values.shape[1] * 2.0**64))
    out_rows, out_path = [], []
    for k in range(0, len(rows), 1 << 14):
        token = (values[rows[k : k + (1 << 14)]].astype(np.uint64) << np.uint64(8)) + np.arange(values.shape[1], dtype=np.uint64)
        h = mix64(mix64(token) ^ path[k : k + (1 << 14), None])
        i, j = np.nonzero(h < bound)
        out_rows.append(rows[k + i])
        out_path.append(mix64(h[i, j] + np.uint64(1)))
    return (np.concatenate(out_rows), np.concatenate(out_path)) if out_rows else (rows[:0], path[:0])


def _alike(sketch: np.ndarray) -> np.ndarray:
    """For members of a node: the smallest index that each reaches by ties of sketches.

    A member that has been reached is not compared again, so a large group of copies takes linear time.
    """
    root = np.full(len(sketch), -1)
    for i in range(len(sketch)):
        if root[i] >= 0:
            continue
        root[i], front = i, [i]
        while front:
            open_ = np.flatnonzero(root < 0)
            if not len(open_):
                break
            near = open_[(sketch[open_] == sketch[front.pop()]).sum(1) >= SKETCH_LEAST]
            root[near] = i
            front += near.tolist()
    return root


def _small_nodes(sketch: np.ndarray, node: int, trees: int = 12, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """The rows of a node, or of the nodes below it, again and again, where it is too large and branching parts its members.

    Each of a large node's `trees` branchings is repeated below, so a pair that meets in a node meets in a small one
    below it with probability 1 - (1 - 0.63) ** trees at a similarity of 0.8.
    """
    ahead = [(np.arange(len(sketch)), node)]
    while ahead:
        rows, node = ahead.pop()
        below = []
        for tree in range(trees if len(rows) > leaf else 0):
            seed = mix64(np.array([node ^ (tree + 1)], np.uint64))[0]
            at, path = _branch(np.arange(len(rows)), np.full(len(rows), seed), sketch[rows])
            order = np.argsort(path, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(path[order]) != 0, True])
            found = [(rows[at[order[a:b]]], int(path[order[a]]) & 0x7FFFFFFFFFFF) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1]
            if max((len(own) for own, _ in found), default=0) > len(rows) // 4:  # alike for the most part: comparing is quick
                below = []
                break
            below += found
        else:
            if len(rows) > leaf:
                ahead += below
                continue
        yield rows


def find_ties(classes: DataFrame, similarity: float, depth: int, trees: int) -> DataFrame:
    """Links (u, v) between classes (cid, signature) that may be similar."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                cid = b.column(0).to_numpy()
                values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, SIGNATURE)
                sketch = (values[:, :SKETCH] & 255).astype(np.uint8)
                for tree in range(trees):
                    rows = np.arange(len(cid))
                    path = np.full(len(rows), mix64(np.array([tree + 1], np.uint64))[0])
                    for _ in range(depth):
                        rows, path = _branch(rows, path, values)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(cid[rows]), pa.array([x.tobytes() for x in sketch[rows]], pa.binary())], ["node", "cid", "sketch"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches, 1):
            if b.num_rows < 2:
                continue
            node, cid = b.column(0).to_numpy(), b.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
            edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            size = np.diff(edge)
            out = []
            small = np.repeat(size <= 12, size)
            for step in range(1, 12):  # small nodes: all members at each distance at once
                left = np.flatnonzero((node[step:] == node[:-step]) & small[step:])
                if not len(left):
                    break
                left = left[(sketch[left] == sketch[left + step]).sum(1) >= SKETCH_LEAST]
                out.append((cid[left + step], cid[left]))
            for i in np.flatnonzero(size > 12):
                a, z = edge[i], edge[i + 1]
                for rows in _small_nodes(sketch[a:z], int(node[a]) & 0x7FFFFFFFFFFF):
                    root = _alike(sketch[a:z][rows])
                    tied = root != np.arange(len(rows))
                    out.append((cid[a:z][rows[tied]], cid[a:z][rows[root[tied]]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["u", "v"])

    entries = classes.select("cid", "signature").mapInArrow(trimmed(grow), "node long, cid long, sketch binary")
    return entries.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(trimmed(compare), "u long, v long")


def linked(sets: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For ascending sets (rows by offsets): which pairs have 100 * intersection >= percent * union."""
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    values, column, often = np.unique(sets, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    use = often[column] > 1
    row, column = row[use], number[column[use]]
    both = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = max(1024, (16 << 20) // n)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, (k, k + wide))
        part = np.zeros((n, min(wide, int(column[-1]) + 1 - k)), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        both += part @ part.T
    return (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (size[:, None] > 0) & (size[None, :] > 0)


def _forests(rows: DataFrame, keys: int, percent: int) -> DataFrame:
    """Links (u, v) that span what is linked in each group; rows: `keys` group columns, cid, members (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches, keys):
            if b.num_rows < 2:
                continue
            marks = [b.column(i).to_numpy() for i in range(keys)]
            new = np.zeros(b.num_rows - 1, bool)
            for m in marks:
                new |= m[1:] != m[:-1]
            edge = np.flatnonzero(np.r_[True, new, True])
            cid, out = b.column(keys).to_numpy(), []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j - i > 1:
                    own = [np.frombuffer(x, np.uint64) for x in b.column(keys + 1).slice(i, j - i).to_pylist()]
                    root = reach(linked(np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])], percent))
                    tied = np.flatnonzero(root != np.arange(j - i))
                    out.append((cid[i + tied], cid[i + root[tied]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["u", "v"])

    names = rows.columns[:keys]
    return rows.repartition(*names).sortWithinPartitions(*names, "cid").mapInArrow(trimmed(run), "u long, v long")


def _full_sets(docs: DataFrame, chosen: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """group, chunk, cid, members (ascending 64-bit hashes) of chosen classes (doc, digest, group, chunk, cid)."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if chosen.count() * 64 < 48 << 20:  # narrow rows of fixed width
        chosen = F.broadcast(chosen)
    found = text.join(chosen, text["id"].eqNullSafe(chosen["doc"])).select("group", "chunk", "cid", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in pieces(batches, "text"):
            sets, rows = shingles(raw, at, width)
            same = np.array([x == y for x, y in zip(_digests(sets, rows), part.column(3).to_pylist(), strict=True)])  # else another document with that id
            members = pa.array([sets[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), members], ["group", "chunk", "cid", "members"]).filter(pa.array(same))

    return found.mapInArrow(trimmed(run), "group long, chunk long, cid long, members binary")


def class_roots(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of all classes that are linked with another."""
    depth, trees = plan_trees(classes.count(), percent / 100)
    ties = components(find_ties(classes, percent / 100, depth, trees))
    sizes = ties.groupBy("root").agg(F.count("*").alias("size"))
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / CHUNK))
    chosen = ties.withColumnRenamed("node", "cid").join(sizes, "root").join(classes, "cid")
    chosen = kept(chosen.select(F.col("id").alias("doc"), "digest", F.col("root").alias("group"), chunk.alias("chunk"), "cid", "size"))
    sets = kept(_full_sets(docs, chosen.drop("size"), width, id_col, text_col))
    links = kept(_forests(sets, 2, percent))
    roots = _roots(chosen, sets, links, percent)
    for df in (links, sets, chosen):  # roots are a table of their own
        df.unpersist()
    return roots


def _roots(chosen: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Components of the links; of large groups, what lies outside their main parts is compared with all of the group."""
    roots = components(links)
    large = chosen.where(F.col("size") > CHUNK).select("group", "cid")
    if large.isEmpty():
        return roots
    parts = large.join(roots, F.col("cid") == F.col("node"), "left").select("group", "cid", F.coalesce("root", "cid").alias("part"))
    counts = parts.groupBy("group", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("group").agg(F.max(F.struct("n", "part"))["part"].alias("main"))
    outside = kept(parts.join(main, "group").where("part <> main").select("group", "cid"))
    if outside.isEmpty():
        return roots
    left = outside.withColumn("of", F.count("*").over(W.partitionBy("group"))).withColumn("block", F.pmod(F.xxhash64("cid"), F.ceil(F.col("of") / CHUNK)))
    blocks = left.select("group", "block").distinct()
    whole = sets.join(blocks, "group").select("group", "block", "chunk", "cid", "members")
    chunks = sets.select("group", "chunk").distinct()
    again = sets.drop("chunk").join(left.select("group", "cid", "block"), ["group", "cid"]).join(chunks, "group").select("group", "block", "chunk", "cid", "members")
    more = _forests(whole.unionByName(again), 3, percent)
    roots = components(links.unionByName(more))
    outside.unpersist()
    return roots


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept."""
    return _near_copies(docs, width, percent, id_col, text_col).drop("key")


def _near_copies(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    rows = kept(signatures(docs, width, id_col, text_col, key))
    grouped = rows.where("n > 0").groupBy("n", "digest").agg(F.min("id").alias("id"), F.min("signature").alias("signature"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "n", "digest", "id", "signature"), "classes")
    roots = class_roots(docs, classes, width, percent, id_col, text_col)
    tied = classes.select("cid", F.col("n").alias("size"), F.col("digest").alias("own"), F.col("id").alias("least")).join(roots, F.col("cid") == F.col("node"), "left")
    tied = tied.withColumn("root", F.coalesce("root", "cid"))
    lowest = tied.groupBy("root").agg(F.min("least").alias("lowest"))
    told = tied.join(lowest, "root").select("size", "own", "lowest")
    out = rows.select("id", "n", "digest", "key").join(told, (F.col("n") == F.col("size")) & (F.col("digest") == F.col("own")), "left")
    component = F.coalesce("lowest", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "key")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: those go, by id and text, that near_copies() doesn't keep."""
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    gone = _near_copies(docs, width, percent, "doc_id", "text", key).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & (F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == gone["__key"])
    return docs.join(gone, same, "left_anti")


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT r.u, p.v FROM r JOIN p ON p.u = r.c)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = s.doc_id
"""
