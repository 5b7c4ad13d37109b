"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmeter.llm.hot import join_by_key
from docmeter.llm.workspace import drop, stored

#: Rounds keep about this many edges in a file, so that small tables aren't spread over as many files as partitions.
EDGES_A_FILE = 200_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links`` that is not the smallest of its component.

    ``component`` is the smallest node that links reach. Null ends, loops and repeated links have no effect; an empty
    table gives an empty one. Each round aggregates before its join, so a node with very many links never meets them in
    one task, and writes its edges to the shared folder; the number of rounds grows with the logarithm of the longest
    chain. Only a row count and a checksum reach the driver.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    before = _state(edges)
    while before[0]:
        files = 1 + before[0] // EDGES_A_FILE
        last, edges = edges, stored(_small_star(_large_star(edges)).coalesce(files), "edges")
        drop(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_by_key(both.filter("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_by_key(edges, least, ["u"], ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
