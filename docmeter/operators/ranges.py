"""Joins of points with the ranges that hold them, and numbers of rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.sources.folders import stored


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows that a join brings to the other side by a shuffle, whatever their size is thought to be.

    What is parsed from a program is many times its estimate, which knows the columns read and not the texts made of them;
    sent to every task instead, it would pass whole through the driver.
    """
    return rows.hint("merge")


def containing_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Every point with every range of its keys that holds it (``lo <= at <= hi``).

    Points and ranges are cut into buckets of ``width``, and joined on keys and bucket: a point meets only ranges that
    reach its bucket, not all of its key. A range is copied once for each bucket that it reaches, so ``width`` should be
    about as wide as ranges are. Nulls and empty ranges hold nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    reached = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return points.withColumn("_bucket", bucket(at)).join(reached, [*keys, "_bucket"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_bucket")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their number, from 1, within their keys (not null) in order, whatever share of the rows has one key.

    Rows are dealt by ranges of keys and order, and stored; each part numbers its own, and a key's rows in the parts before
    it are added from counts, of which there are as many as there are parts with the key. Rows of equal keys and order stay
    in one part.
    """
    dealt = stored(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(counts, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
