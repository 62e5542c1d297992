"""Structured Streaming: event files to job states and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import status_of

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files of a folder or glob as a stream, with an event time that watermarks can use."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, status, n: events by time window and the status that they mean."""
    status = status_of(F.col("event_type")).alias("status")
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is and stops; the checkpoint makes a rerun go on where it ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def job_states(events: DataFrame) -> DataFrame:
    """job, status, changes: each job's state after its latest event; for complete or update mode."""
    last = F.max_by(status_of(F.col("event_type")), F.struct("at", "event_id"))
    return events.groupBy(F.col("user_id").alias("job")).agg(last.alias("status"), F.count("*").alias("changes"))


def activity(events: DataFrame, silence: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """job, start, end, n: stretches of a job's events without a silence; a stretch's end is where a stall may begin."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", silence).alias("w"), F.col("user_id").alias("job")).agg(F.count("*").alias("n")).select("job", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """events without those that were delivered again within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
