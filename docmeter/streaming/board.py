"""Boards over streams of results: component sums by model, kept up to date or closed by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(results: DataFrame, time: str, group: str, value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean of a group in tumbling windows; rows later than the watermark are dropped from streams."""
    rows = results.withWatermark(time, late) if results.isStreaming else results
    out = rows.groupBy(F.window(time, length).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), group, "n", F.round("mean", 6).alias("mean"))


def running_board(results: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Counts and means by group over all rows so far (complete or update mode)."""
    return results.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"avg_{v}") for v in values])


def write_to_memory(stream: DataFrame, name: str, mode: str = "complete"):
    """Start a query into a named in-memory table."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
