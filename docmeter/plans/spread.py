"""Rows dealt out before dear work."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores if it comes in fewer, as from a file of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(keys: DataFrame, most: int = 50_000) -> DataFrame:
    """Short rows that long work follows, evenly in parts of about ``most`` rows at most, as many for each core.

    How a file is cut says nothing about its rows: a row group is read by one task, however many parts it is cut into. Rows
    are counted first (those of a file in its footers), so that with more of them tasks grow in number and not in length.
    """
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(cores * max(1, ceil(keys.count() / (cores * most))))
