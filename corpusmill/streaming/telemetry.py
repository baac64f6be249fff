"""An extra beyond batch: run telemetry as a stream, counted by time windows with late data held to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, mean) of a stream or table of events (ts, event_type, value)."""
    w = F.window("ts", window)
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
