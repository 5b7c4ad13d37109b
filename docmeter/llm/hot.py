"""Joins on keys that may be hot: the rows of one key are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt into.
PARTS = 256


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], by: list[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row for each of its ``keys``.

    Rows are dealt by a hash of ``by`` into parts of their key. The parts that exist (at most ``parts`` a key, found with
    map-side aggregation) meet the key's row; rows meet it part by part, so that no task takes all rows of a key. Null
    keys match nothing, and are dealt likewise.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    there = dealt.select(*keys, "_part").distinct().join(per_key, keys)
    return dealt.join(there, [*keys, "_part"], how).drop("_part")
