"""Streaming ingest of detections: duplicates dropped under a watermark, and counts by night and observatory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str = "id", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each id once; its state is dropped after ``delay`` of event time, so it does not grow without bound."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def night_counts(stream: DataFrame, code: str = "code", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Detections a night and observatory, emitted once a night is over and its late rows are in."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day", startTime="12 hours"), code)
    return windowed.agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).select(F.col("window.start").alias("night"), code, "n", "ids")
