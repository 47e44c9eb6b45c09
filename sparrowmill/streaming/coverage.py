"""Streaming twins: the event stream as JSON files, counted by page and session with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def visits(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Visits and first step of each page in each session and window; works on streams and tables alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(F.count("*").alias("visits"), F.min("event_id").alias("first_step")).select(F.col("w.start").alias("start"), "user_id", "event_type", "visits", "first_step")


def first_of_each(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, by id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
