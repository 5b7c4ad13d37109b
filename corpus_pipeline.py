"""The corpus pipeline: stages over ``documents``, each stored as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmeter.llm import language, minhash, packing, quality
from docmeter.llm.workspace import stored

#: Name and function (spark, docs, sf_dir) of each stage, in order.
STAGES = [
    ("quality_rules", quality.stage),
    ("language_id", language.stage),
    ("minhash_near_dedup", minhash.stage),
    ("packing", packing.stage),
]

#: Language identification and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents that all stages keep, one row for each piece of a document.

    Every stage reads what the one before it stored in the shared folder, so that a lost executor costs its tasks of the
    stage at hand. Null, empty and letterless texts go in the first two stages; of copies and near copies one stays, also
    where ids are repeated or null; columns of any name stay up to the last stage; an empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
