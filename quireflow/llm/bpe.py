"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The distinct pre-tokens of a part of the input are laid out as one linked list of symbols (pairs never cross a
pre-token's end). For every merge rank there is a bucket of list positions whose pair has that rank; a bitmap of
three levels with 64 bits a word says which buckets have entries, and find-first-set gives the lowest rank in a
fixed number of steps. A bucket's entries are merged from left to right; entries whose pair has changed meanwhile
are stale and skipped; the pairs that a merge makes go into their own buckets. A pre-token of any length so costs
about as many steps as it has bytes, and short pre-tokens share the work of a bucket.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded each; special
tokens' strings are ordinary text; an id outside the vocabulary makes decode() fail.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes, trim, trimmed

NONE = 1 << 30
BATCH_BYTES = 4 << 20
KNOWN = 100_000
AT_ONCE = 40_000
FEW = 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank below a bitmap of three levels (2**18 ranks)."""

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("at most 2**18 ranks")
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0
        self.first: dict[int, np.ndarray] = {}
        self.more: dict[int, list[int]] = {}

    def _mark(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def fill(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, own in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else (), np.split(places, cuts), strict=False):
            self.first[rank] = own
            self._mark(rank)

    def push(self, rank: int, place: int) -> None:
        more = self.more.get(rank)
        if more is None:
            self.more[rank] = [place]
            self._mark(rank)
        else:
            more.append(place)

    def pop(self) -> tuple[int, np.ndarray | None, list[int]] | None:
        """The lowest rank that has entries, with all of them."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) + (word & -word).bit_length() - 1
        word = self.low[b]
        rank = (b << 6) + (word & -word).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.first.pop(rank, None), self.more.pop(rank, [])


class Codec:
    """Encodes and decodes by a table of ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.size = ranks, regex.compile(pattern).findall, max(ranks.values()) + 1
        self.pairs = {(ranks[t[:i]] << 18) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bytes_of = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._index_pairs()
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _index_pairs(self) -> None:
        """An open hash table of the pairs for look-ups by whole arrays."""
        keys, ranks = np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.vals = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            slot, keys, ranks = slot & ((1 << self.bits) - 1), keys, ranks
            free = self.keys[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.vals[slot[put]] = keys[put], ranks[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            slot, keys, ranks = slot[left] + 1, keys[left], ranks[left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none."""
        keys = (a.astype(np.int64) << 18) | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.vals[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and the offsets of each piece's ids."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        edge = np.r_[0, np.cumsum(sizes)]
        n = int(edge[-1])
        sym = self.bytes_of[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[edge[1:][sizes > 0] - 1] = -1
        prv[edge[:-1][sizes > 0]] = -1
        rank = np.full(n, NONE, np.int32)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)  # a piece that is a token is done
        inner = np.flatnonzero((nxt >= 0) & (whole[owner] < 0)) if n else np.zeros(0, np.int64)
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        queue = RankQueue(self.size)
        ready = inner[rank[inner] < NONE]
        queue.fill(rank[ready], ready)
        self._merge(queue, sym, nxt, prv, rank, owner)
        alone = whole >= 0
        sym[~np.isin(np.arange(n), edge[:-1][alone]) & alone[owner]] = -1
        sym[edge[:-1][alone]] = whole[alone]
        live = sym >= 0
        return sym[live], np.r_[0, np.cumsum(live)][edge]

    def _merge(self, queue: RankQueue, sym, nxt, prv, rank, owner) -> None:
        s, after, before, at = memoryview(sym), memoryview(nxt), memoryview(prv), memoryview(rank)
        pair, push = self.pairs.get, queue.push
        while (entry := queue.pop()) is not None:
            r, first, more = entry
            if (0 if first is None else len(first)) + len(more) >= FEW:
                self._merge_many(queue, r, np.unique(np.r_[first if first is not None else np.zeros(0, np.int64), np.array(more, np.int64)]), sym, nxt, prv, rank, owner)
                continue
            places = sorted({*more, *first.tolist()} if first is not None else set(more))
            for k, p in enumerate(places):
                if at[p] != r:
                    continue
                q = after[p]
                right, left = after[q], before[p]
                s[p], s[q], at[q], after[p] = r, -1, NONE, right
                lower = False
                if right >= 0:
                    before[right] = p
                    new = pair((r << 18) | s[right], NONE)
                    at[p] = new
                    if new < NONE:
                        push(new, p)
                        lower = new < r
                else:
                    at[p] = NONE
                if left >= 0:
                    new = pair((s[left] << 18) | r, NONE)
                    at[left] = new
                    if new < NONE:
                        push(new, left)
                        lower |= new < r
                if lower:  # that pair comes before what is left of this bucket
                    for p in places[k + 1 :]:
                        push(r, p)
                    break

    def _merge_many(self, queue: RankQueue, r: int, p: np.ndarray, sym, nxt, prv, rank, owner) -> None:
        """One bucket by whole arrays; p ascends."""
        p = p[rank[p] == r]
        if not len(p):
            return
        q = nxt[p]
        joined = np.r_[False, q[:-1] == p[1:]]  # shares a symbol with the pair before it: a run of one symbol
        if joined.any():
            run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(p))))
            p = p[(np.arange(len(p)) - run) % 2 == 0]
            q = nxt[p]
        right, left = nxt[q], prv[p]
        touch = np.r_[False, (q[:-1] == left[1:])]
        to_right = np.where(right >= 0, self.pair_ranks(np.full(len(p), r), np.maximum(sym[right], 0)), NONE)
        to_left = np.where(left >= 0, self.pair_ranks(np.where(touch, r, np.maximum(sym[left], 0)), np.full(len(p), r)), NONE)
        if (to_right < r).any() or (to_left < r).any():  # a lower rank appears: only each piece's leftmost pair now
            lead = np.r_[True, np.diff(owner[p]) != 0]
            for x in p[~lead].tolist():
                queue.push(r, x)
            p, q, right, left = p[lead], q[lead], right[lead], left[lead]
        sym[p], sym[q], rank[q], nxt[p] = r, -1, NONE, right
        has = right >= 0
        prv[right[has]] = p[has]
        rank[p] = NONE
        here, there = p[has], nxt[p[has]]
        rank[here] = self.pair_ranks(sym[here], sym[there])
        behind = prv[p]
        behind = behind[behind >= 0]
        rank[behind] = self.pair_ranks(sym[behind], sym[nxt[behind]])
        changed = np.unique(np.r_[here, behind])
        new = rank[changed]
        push = queue.push
        for x, y in zip(new[new < NONE].tolist(), changed[new < NONE].tolist(), strict=True):
            push(x, y)

    def learn(self, texts: list[str]) -> list[array]:
        """Each text as numbers of distinct pre-tokens, all of which are encoded then."""
        known, new, out = self.known, [], []
        if len(known) > KNOWN:
            self.forget()
        for text in texts:
            row = array("i")
            add = row.append
            for piece in self.split(text):
                number = known.get(piece)
                if number is None:
                    number = known[piece] = len(known)
                    new.append(piece.encode("utf-8", "surrogatepass"))
                add(number)
            out.append(row)
        done, total = [(self.ids, self.at)], self.at[-1]
        for k in range(0, len(new), AT_ONCE):
            ids, at = self.encode_pieces(new[k : k + AT_ONCE])
            done.append((ids, at[1:] + total))
            total += len(ids)
        self.ids, self.at = (np.concatenate([x[i] for x in done]) for i in (0, 1))
        return out

    def forget(self) -> None:
        self.known.clear()
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ragged(self.ids, self.at, np.frombuffer(row, np.int32) if len(row) else np.zeros(0, np.int32)) for row in self.learn(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.lengths[ids].all()):
            raise ValueError("an id outside the vocabulary")
        return ragged(self.flat, self.starts, ids).tobytes()


def ragged(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given rows one after another, where row i is values[at[i]:at[i + 1]]."""
    if not len(rows):
        return values[:0]
    begin = at[rows]
    sizes = at[rows + 1] - begin
    ends = np.cumsum(sizes)
    return values[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])]


_codec: tuple[object, Codec] | None = None


def _shared(ranks, pattern: str) -> Codec:
    """The worker's codec; ranks is a broadcast, read once in each Python worker."""
    global _codec
    if _codec is None or _codec[0] != (ranks.id if hasattr(ranks, "id") else id(ranks), pattern):
        _codec = ((getattr(ranks, "id", id(ranks)), pattern), Codec(ranks.value, pattern))
    return _codec[1]


def _binary(values: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([v if isinstance(v, bytes) else v.tobytes() for v in values], pa.binary())


class Tokenizer:
    """BPE over DataFrames; the vocabulary (a table of fixed size) is broadcast once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        if len(ranks) > 1 << 18:
            raise ValueError("the vocabulary is too large to broadcast")
        self.ranks, self.pattern = spark.sparkContext.broadcast(ranks), pattern

    def encode(self, docs: DataFrame, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
        """docs with a column of ids: little-endian unsigned 32-bit integers.

        decoded names a further column, what decode() makes of the ids; the same worker then does both.
        """
        ranks, pattern, batch = self.ranks, self.pattern, BATCH_BYTES
        added = [out] if decoded is None else [out, decoded]
        if clash := set(added) & set(docs.columns):
            raise ValueError(f"there are columns {clash}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _shared(ranks, pattern)

            def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                trim()
                texts = [x if x is not None else "" for b in held for x in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                rows, k = codec.learn(texts), 0
                del texts
                for b in held:
                    for part in _slices(b, text_col, 1 << 20):
                        own = rows[k : k + part.num_rows]
                        k += part.num_rows
                        ids = [ragged(codec.ids, codec.at, np.frombuffer(x, np.int32)) if len(x) else b"" for x in own]
                        new = [_binary(ids)]
                        if decoded is not None:
                            new.append(_binary([codec.decode(np.asarray(x)) if len(x) else b"" for x in ids]))
                        yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *added])
                        del ids, new

            held, size = [], 0
            for b in batches:
                for part in _slices(b, text_col, batch):
                    held.append(part)
                    size += part.column(part.schema.get_field_index(text_col)).nbytes
                    if size >= batch:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)
            codec.forget()

        return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *[T.StructField(c, T.BinaryType()) for c in added]]))

    def decode(self, encoded: DataFrame, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
        """encoded with a column of the bytes that the ids stand for."""
        ranks, pattern = self.ranks, self.pattern
        if out in encoded.columns:
            raise ValueError(f"there is a column {out}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _shared(ranks, pattern)
            for b in batches:
                for part in _slices(b, ids_col, 8 << 20):
                    own = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                    yield pa.RecordBatch.from_arrays([*part.columns, _binary([codec.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in own])], [*part.schema.names, out])

        return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows into parts of about `limit` bytes of a column."""
    col = batch.column(batch.schema.get_field_index(column))
    _, at = text_bytes(col.cast(pa.string()) if pa.types.is_null(col.type) else col) if not pa.types.is_binary(col.type) else (None, _binary_offsets(col))
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _binary_offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents by the 50k byte-level vocabulary."""
    import public_tokenizers

    bpe = Tokenizer(docs.sparkSession, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.encode(docs.select("doc_id", "text"), decoded="decoded")
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
