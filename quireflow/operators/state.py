"""State tables: jobs, page tasks, cache with expiry, assets by content, shards of binary values, task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an event means for its job.
STATUS = {"view": "pending", "click": "running", "purchase": "done", "error": "failed"}


def status_of(event: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, event), F.lit("running"))


def latest_jobs(events: DataFrame) -> DataFrame:
    """job, status, created, updated, changes: the state of each job after its last event (ties: the largest id)."""
    last = F.max_by(status_of(F.col("event_type")), F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("job")).agg(last.alias("status"), F.min("ts").alias("created"), F.max("ts").alias("updated"), F.count("*").alias("changes"))


def recover(jobs: DataFrame) -> DataFrame:
    """job, status after a crash: what was running waits again."""
    return jobs.select("job", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")).alias("status"), (F.col("status") == "running").alias("recovered"))


def stalls(events: DataFrame, seconds: int) -> DataFrame:
    """job, at, gap: where a job was silent for longer than `seconds`."""
    at = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(at).cast("timestamp"))
    return events.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), gap.alias("gap")).where(F.col("gap") > seconds)


def evict(cache: DataFrame, most: int, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """cache (key, mtime) that stays: first what is too old goes, then the oldest beyond `most` entries.

    Each task keeps its own newest ones, and only these meet.
    """
    if ttl_seconds is not None and now is not None:
        cache = cache.where(F.col("mtime") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
    return cache.orderBy(F.col("mtime").desc(), F.col("key").desc()).limit(most)


def merge_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of cache entries (key, page, blocks and further columns of both): a new page wins if there is no old one,
    the old one has no blocks, or the new one has some."""
    rest = [c for c in old.columns if c not in ("key", "page")]
    o, n = old.select("key", "page", F.struct(*rest).alias("o")), new.select("key", "page", F.struct(*rest).alias("n"))
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    wins = F.col("n").isNotNull() & (F.col("o").isNull() | ~filled(F.col("o.blocks")) | filled(F.col("n.blocks")))
    both = o.join(n, ["key", "page"], "full")
    return both.select("key", "page", F.when(wins, F.col("n")).otherwise(F.col("o")).alias("x")).select("key", "page", "x.*")


def asset_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def asset_store(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets (asset_id, bytes, links) and links (block_id, asset_id) of owners (block_id, content)."""
    links = owners.select("block_id", asset_id(F.col("content")).alias("asset_id"), F.octet_length("content").cast("long").alias("bytes"))
    return links.groupBy("asset_id").agg(F.max("bytes").alias("bytes"), F.count("*").alias("links")), links.select("block_id", "asset_id")


def shards(values: DataFrame, size: int) -> DataFrame:
    """key, part, content: values (key, content) cut into parts of `size` bytes."""
    count = F.ceil(F.octet_length("content") / F.lit(size))
    parts = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))))
    return parts.select("key", F.col("part").cast("int").alias("part"), F.substring("content", F.col("part").cast("int") * size + 1, F.lit(size)).alias("content"))


def reassemble(parts: DataFrame) -> DataFrame:
    """key, content of shards(); content is binary."""
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p"))
    return whole.select("key", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["content"])).alias("content"))


def shard_manifest(parts: DataFrame) -> DataFrame:
    """key, part, bytes, sha256 of shards()."""
    return parts.select("key", "part", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_shards(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """key, intact: whether every part that the manifest lists is there once, with its size and digest, and no other."""
    found = shard_manifest(parts).groupBy("key", "part").agg(F.count("*").alias("n"), F.max("bytes").alias("b"), F.max("sha256").alias("s"))
    both = manifest.join(found, ["key", "part"], "full")
    right = F.coalesce((F.col("n") == 1) & (F.col("b") == F.col("bytes")) & (F.col("s") == F.col("sha256")), F.lit(False))
    return both.groupBy("key").agg(F.min(right).alias("intact"))


def levels(spark, nodes: str, edges: str) -> DataFrame:
    """name, level of each node of a task graph: the longest path to it; nodes (name), edges (src, dst): view names."""
    return spark.sql(f"""
        WITH RECURSIVE r AS (
          SELECT name, 0 AS level FROM {nodes} WHERE name NOT IN (SELECT dst FROM {edges})
          UNION ALL SELECT e.dst, r.level + 1 FROM r JOIN {edges} e ON e.src = r.name
        ) SELECT name, max(level) AS level FROM r GROUP BY name""")
