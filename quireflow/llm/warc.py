"""WARC archives with a Zstandard dictionary, and de-duplication of payloads by revisit records.

Every task writes archive files of its own: a leading skippable frame with a dictionary, which is trained on some of
the task's records, then one frame for each record, so that a record can be read alone. Files are written under
another name and renamed when complete; the content of a task is put in a fixed order, which goes by a hash, so that
the records trained on are a spread sample and a task that is run again writes the same files. The shared folder may
be a local (shared) path or any URI that pyarrow.fs knows; an archive that the driver can't see afterwards is an error.

Of records with equal payloads (by SHA-256) of at least `least` bytes, the one with the smallest page_id (then url)
is a response and the others are revisits that refer to it. Records are told apart by page_id, url and digest, and
copies of one row by their number, so nothing hangs on the order in which rows are read.

Defined results: a null html is an empty payload, a null url leaves the target URI out; a null page_id is the
largest; of repeated rows with the smallest page_id and url one is the response; an empty table gives no archive and
no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

LEAST, ROLL, SAMPLE, DICTIONARY, LEVEL = 100, 32 << 20, 2 << 20, 48 << 10, 3
DATE = "2020-01-01T00:00:00Z"
#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:quireflow:page:"


def plan_records(pages: DataFrame, least: int = LEAST, salts: int = 16) -> DataFrame:
    """One row for each record: page_id, url, html, size (its bytes), digest, record, revisit, first_id, first_record.

    record: a name that tells records of a page_id apart; first_id, first_record: the response that a revisit refers
    to. html is null for revisits. The payloads are shuffled once, those of one digest to `salts` tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    name = F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col("url"), F.lit("")), F.col("url").isNull().cast("string"), F.col("digest"))), 1, 16)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    groups = rows.where(F.col("size") >= least).groupBy(F.col("digest").alias("same")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("n")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).repartition("digest", "salt")
    each = salted.groupBy("digest", "salt", "page_id", "url").agg(F.first("html").alias("html"), F.first("size").alias("size"), F.count("*").alias("copies"))
    out = each.join(groups, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("part")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    out = out.withColumn("revisit", F.when(F.col("size") < least, F.lit(False)).when(F.col("first").isNull(), F.col("copy") > 0).otherwise(~own | (F.col("copy") > 0)))
    out = out.withColumn("record", F.concat_ws("-", name, F.col("copy").cast("string")))
    first = F.coalesce("first", order)
    out = out.withColumn("first_id", F.when(F.col("revisit"), first["page_id"])).withColumn("first_url", F.when(F.col("revisit"), first["url"]))
    named = F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col("first_url"), F.lit("")), F.col("first_url").isNull().cast("string"), F.col("digest"))), 1, 16)
    return out.select(
        "page_id",
        "url",
        F.when(~F.col("revisit"), F.col("html")).alias("html"),
        "size",
        "digest",
        "record",
        "revisit",
        "first_id",
        F.when(F.col("revisit"), F.concat(named, F.lit("-0"))).alias("first_record"),
    )


def record(page_id, url, html: str | None, size: int, digest: str, name: str, revisit: bool, first_id, first_name) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{page_id}:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{NAME}{first_id}:{first_name}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += html.encode("utf-8", "surrogatepass")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; too few to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [r[:16384] for r in records], k=1024, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY:].rjust(8, b" "), zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    data = dictionary.as_bytes()
    return struct.pack("<II", SKIPPABLE, len(data)) + data


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, by its header and those of its blocks."""
    magic, flags = struct.unpack_from("<IB", data, at)
    if magic != FRAME:
        raise ValueError(f"no Zstandard frame at {at}")
    single = flags >> 5 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


class _Store:
    """Writing complete files below a local path or URI."""

    def __init__(self, path: str):
        scheme = re.match(r"([\w+.-]+):", path)
        self.fs, self.path = None, path
        if scheme and scheme[1] != "file":
            import pyarrow.fs

            self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path)
        elif scheme:
            self.path = re.sub(r"^file:/+", "/", path)

    def put(self, name: str, data: list[bytes], attempt: int) -> None:
        part, whole = f"{self.path}/.{name}.{attempt}", f"{self.path}/{name}"
        if self.fs:
            self.fs.create_dir(self.path, recursive=True)
            with self.fs.open_output_stream(part) as f:
                for x in data:
                    f.write(x)
            self.fs.move(part, whole)
            return
        os.makedirs(self.path, exist_ok=True)
        with open(part, "wb") as f:
            f.writelines(data)
        os.replace(part, whole)


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> tuple[int, int]:
    """Writes the records of pages (page_id, url, html) below path; returns how many records and compressed bytes."""
    spark = pages.sparkSession
    rows = plan_records(pages, least).sortWithinPartitions(F.xxhash64("page_id", "record"), "page_id", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, store = TaskContext.get(), _Store(path)
        held: list[bytes] = []  # the first records, until there are enough for a dictionary
        frames: list[bytes] = []
        state = {"size": 0, "file": 0, "held": 0, "records": 0, "bytes": 0, "files": 0}
        press = None

        def close() -> None:
            store.put(f"part-{task.partitionId():06d}-{state['file']:04d}.warc.zst", frames, task.taskAttemptId())
            state["bytes"] += sum(map(len, frames))
            state["files"] += 1
            state["file"] += 1
            state["size"] = 0
            del frames[1:]

        def begin() -> zstandard.ZstdCompressor:
            dictionary = build_dictionary(held)
            frames.append(dictionary_frame(dictionary))
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)

        def add(x: bytes) -> None:
            frames.append(press.compress(x))
            state["size"] += len(x)
            state["records"] += 1
            if state["size"] >= ROLL:
                close()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = record(*row)
                if press is None:
                    held.append(x)
                    state["held"] += len(x)
                    if state["held"] >= SAMPLE:
                        press = begin()
                        for y in held:
                            add(y)
                        held.clear()
                else:
                    add(x)
        if held:
            press = begin()
            for y in held:
                add(y)
        if len(frames) > 1:
            close()
        yield pa.RecordBatch.from_pydict({"records": [state["records"]], "bytes": [state["bytes"]], "files": [state["files"]]})

    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    done = rows.mapInArrow(run, "records long, bytes long, files long").agg(total("records"), total("bytes"), total("files")).first()
    if done[2]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.warc.zst")
        found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if found is None or len(found) < done[2]:
            raise RuntimeError(f"{done[2]} archives were written, but not to a folder that the driver shares: {path}")
    return done[0], done[1]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The WARC headers and the block of each record of an archive."""
    view, at = memoryview(data), 0
    open_ = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            if at == 0 and magic == SKIPPABLE:
                open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
            at += 8 + size
            continue
        end = frame_end(view, at)
        text = open_.decompress(view[at:end])
        head, _, block = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, block[: int(fields["Content-Length"])]
        at = end


READ = "page_id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below path; with payloads, also the payload of responses.

    The digest and length of a response are taken from the payload read (and must be as the header says), those of
    a revisit from its headers.
    """
    schema = READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def page(name: str | None) -> int | None:
        found = re.fullmatch(rf"<{NAME}(-?\d+|None):[0-9a-f]+-\d+>", name or "")
        return int(found[1]) if found and found[1] != "None" else None

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        out = (page(fields["WARC-Record-ID"]), fields["WARC-Record-ID"], kind, fields.get("WARC-Target-URI"), size, digest, page(fields.get("WARC-Refers-To")), fields.get("WARC-Refers-To"))
        return (*out, payload if kind == "response" else None) if payloads else out

    arrow = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for fields, block in parse_archive(data.as_py()):
                    rows.append(row(fields, block))
                    size += len(block)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(run, schema)


def op2_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    written, _ = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if not written:
        return spark.createDataFrame([], READ).select(columns)
    return read_archives(spark, path).select(columns)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (
  SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND k > 1 THEN first_id END AS refers_to FROM g
"""
