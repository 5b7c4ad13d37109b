"""The document board: quality of every document, gates by labels, means and ranks by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.functions.text import document_quality
from docmeter.lexicons import CORPUS, Lexicon
from docmeter.plans.spread import spread


def scored_documents(docs: DataFrame, lexicon: Lexicon = CORPUS, unicode: bool = False) -> DataFrame:
    """Documents with their four scores and ``dq``; a document is scored against its own number of lines.

    Documents that come in fewer parts than there are cores, as from a file of one row group, are dealt out before the work.
    """
    docs = spread(docs)
    parts = document_quality("text", F.size(F.split("text", "\n")), lexicon, unicode=unicode)
    total = parts.pop("dq")
    return docs.withColumns(parts).withColumn("dq", total)


def document_board(docs: DataFrame, labels: DataFrame, lexicon: Lexicon = CORPUS, cuts: tuple[int, int, int] = (1_000, 2_000, 4_000), least: float = 0.50) -> DataFrame:
    """Rank of each source by mean quality, with means by size tier, failures (toxic) and share that passes."""
    toxic = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("failed"))
    tier = sum(((F.col("n_chars") >= c).cast("int") for c in cuts), F.lit(1))
    rows = scored_documents(docs.select("doc_id", "source", "text", "n_chars"), lexicon).select("doc_id", "source", "dq", tier.alias("tier")).join(toxic, "doc_id", "left")
    failed = F.coalesce("failed", F.lit(False))
    board = rows.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.round(F.avg("dq"), 6).alias("avg_dq"),
        F.count_if(failed).alias("failures"),
        F.round(F.avg((~failed & (F.col("dq") >= least)).cast("int")), 6).alias("pass_share"),
        *[F.round(F.coalesce(F.avg(F.when(F.col("tier") == t, F.col("dq"))), F.lit(0.0)), 6).alias(f"avg_t{t}") for t in (1, 2, 3, 4)],
    )
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_dq"), "source")))
