"""Structured Streaming over result events: running means and sessions. An addition; the surveyed system has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The events table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 8).parquet(folder)


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its event time as a timestamp and a watermark; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_means(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, mean_value of tumbling windows, closed once the watermark has passed."""
    w = watermarked(events, late)
    g = w.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, n of events with no longer pause than `gap`."""
    w = watermarked(events, late)
    g = w.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), "n")
