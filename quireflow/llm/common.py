"""Shared pieces of the training-data operators: tables, shared folder, vectorised text kernels.

The kernels work on the UTF-8 bytes of an Arrow string column, so no per-row Python objects are made.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: a word is a run of bytes outside this set of white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text.

    translate() makes a Java string of each character, so texts of single bytes go another way, with equal results.
    """
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a plain column would be put in for each use, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies below spark.checkpoint.dir. Where that is unset (tests, local mode) a temporary folder is set; on a
    cluster without the setting this raises, since a machine-local folder would not be seen by the executors.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="quireflow-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quireflow-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, through Spark's own file system layer."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once into blocks on the executors' disks, until unpersist(); lost blocks are made again.

    Where the shared folder is on a local disk, Hadoop starts a process for each file that is written there, and for a
    moment its clone shows all memory of the executor's JVM once more; blocks start none. The mark keeps Spark from
    taking the blocks of an equal plan over files that have changed since.
    """
    out = df.where(F.lit(uuid.uuid4().hex) != "").persist(StorageLevel.DISK_ONLY)
    out.count()
    return out


# --- byte kernels ---------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("_POW", _ODD), ("_INV", inverse)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            globals()[name] = out
    return _POW, _INV


def trim() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the memory that it leaves given back at its end: Python workers outlive a task, idle ones count, too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        trim()

    return whole


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    at = np.frombuffer(off, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches by rows into parts of at most `limit` text bytes (one row at least) with their bytes and offsets."""
    for batch in batches:
        raw, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row, n = 0, len(at) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (n+1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # rows begin and end words
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(begin, at)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, mixed: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand.

    Not mixed, it is the polynomial that the hash is made of.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=total[1:])
    out = (total[end] - total[begin]) * inverse[begin]
    return mix64(out) if mixed else out
