"""Streaming forms of the reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, sum and mean of value per window of ts and event_type; works on streams and tables alike."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    out = kept.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total", "mean")
