"""Structured Streaming twins of the event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def session_counts(events: DataFrame, gap: str = "120 seconds", late: str = "1 hour") -> DataFrame:
    """Events by user and session; a session ends after `gap` of silence, events later than `late` are dropped."""
    windows = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("n"), F.max("value").alias("best")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "best")


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling hours."""
    return _timed(events, late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, within the watermark's memory."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
