"""Streams without redelivered events, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_redelivery(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first of each event that comes again within ``delay``; ``at`` is made a timestamp, as a watermark needs."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, kind, n): events by time window; closed windows only in append mode."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
