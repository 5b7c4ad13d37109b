"""A uniform shuffle into shards of exact sizes: a hypergeometric matrix of partition-to-shard counts, then an exchange."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.llm.workspace import fresh_path, stored

SHARDS = 40
SEED = 20
#: Rows of one shard that one task puts in order.
ROWS_PER_PIECE = 50_000
#: Partitions whose rows of the matrix are written at a time.
PARTS_AT_ONCE = 4096


def communication_matrix(partition_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard, as a uniform permutation of all rows would: exact both ways."""
    draw, left = np.random.default_rng(seed), np.array(shard_rows, np.int64)
    out = np.zeros((len(partition_rows), len(left)), np.int64)
    for p, rows in enumerate(partition_rows):
        out[p] = draw.multivariate_hypergeometric(left, rows, method="marginals")
        left -= out[p]
    return out


def _written(spark: SparkSession, parts: list[int], matrix: np.ndarray) -> DataFrame:
    """The matrix as a table in the shared folder, written some partitions at a time: its size is in no plan, and Spark
    picks the join by what the files hold."""
    path, schema = fresh_path(spark, "shard-matrix"), "array<struct<part int, upto array<bigint>>>"
    for lo in range(0, max(1, len(parts)), PARTS_AT_ONCE):
        some = zip(parts[lo : lo + PARTS_AT_ONCE], np.cumsum(matrix[lo : lo + PARTS_AT_ONCE], axis=1).tolist(), strict=True)
        some = json.dumps([{"part": p, "upto": row} for p, row in some])
        spark.range(1).select(F.inline(F.from_json(F.lit(some), schema))).write.mode("append").parquet(path)
    return spark.read.schema("part int, upto array<bigint>").parquet(path)


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), uniformly at random.

    Shard sizes differ by one at most. The rows' input partitions are stored with a random order each; the driver draws
    how many rows of each partition go to each shard (numbers only: partitions times shards, kept in a table) and every
    partition deals out its rows in its random order; each shard then takes its rows in a second random order. No row's content decides
    anything, so nulls, ties, repeated rows and clashing column names make no difference and all copies of a text may
    part; an empty table gives an empty one. Columns named like the internal ones survive, for the input travels as
    one struct.
    """
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    marked = kept.select("row", F.spark_partition_id().alias("part"), number.alias("number")).withColumn("first_key", F.xxhash64("number", F.lit(seed)))
    marked = stored(marked, "shard-rows")

    counts = {r.part: r.n for r in marked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    bounds = _written(spark, parts, communication_matrix([counts[p] for p in parts], sizes, seed))

    rank = F.row_number().over(Window.partitionBy("part").orderBy("first_key", "number"))
    dealt = marked.withColumn("rank", rank).join(bounds, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))))
    pieces = max(1, -(-total // (shards * ROWS_PER_PIECE)))
    second = F.xxhash64("number", F.lit(seed + 1))
    dealt = dealt.select("row", "shard", second.alias("second_key"), "number").withColumn("piece", F.pmod(F.xxhash64("number", F.lit(seed + 2)), F.lit(pieces)))
    dealt = stored(dealt, "shard-dealt")

    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n")).select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("second_key", "number")) - 1
    placed = dealt.withColumn("within", within).join(offset, ["shard", "piece"])
    return placed.select("row.*", "shard", (F.col("before") + F.col("within")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 40 shards under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(thin)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
