"""Progress, reviews, live updates and counters over event-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING = ["low-confidence", "review-needed"]


def eta(elapsed: Column, current: Column, total: Column) -> Column:
    """The time that is left at the pace so far; null before the first and after the last step."""
    return F.when((current > 0) & (current < total), elapsed / current * (total - current))


def completed_page(tasks: DataFrame) -> DataFrame:
    """job, last: the last page done of each job's tasks (job, page, status), 0 if none."""
    return tasks.groupBy("job").agg(F.coalesce(F.max(F.when(F.col("status") == "done", F.col("page"))), F.lit(0)).alias("last"))


def review_summary(reviews: DataFrame, threshold: float) -> DataFrame:
    """total, pending, below: counts over reviews (status, confidence)."""
    return reviews.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(PENDING)).alias("pending"), F.count_if(F.col("confidence") < threshold).alias("below"))


def apply_actions(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """reviews (block_id, note) with the last of the actions (block_id, seq, action) on each."""
    last = actions.groupBy("block_id").agg(F.max_by("action", "seq").alias("action"), F.count("*").alias("actions"))
    return reviews.join(last, "block_id", "left").withColumn("actions", F.coalesce("actions", F.lit(0)))


def updates_since(updates: DataFrame, since: Column | None) -> DataFrame:
    """updates (ts, ...) after a time, all of them without one."""
    return updates if since is None else updates.where(F.col("ts") > since)


def first_success(attempts: DataFrame) -> DataFrame:
    """job, provider, tries, error: of a job's attempts (job, pos, provider, ok, error) the first that went well, else the last error."""
    won = F.min(F.when(F.col("ok"), F.struct("pos", "provider")))
    return attempts.groupBy("job").agg(won.alias("w"), F.count("*").alias("tries"), F.max(F.struct("pos", "error")).alias("l")).select("job", F.col("w.provider").alias("provider"), "tries", F.when(F.col("w").isNull(), F.col("l.error")).alias("error"))


def latencies(calls: DataFrame) -> DataFrame:
    """provider, method, calls, slowest of calls (provider, method, elapsed_ms)."""
    return calls.groupBy("provider", "method").agg(F.count("*").alias("calls"), F.max("elapsed_ms").alias("slowest"))
