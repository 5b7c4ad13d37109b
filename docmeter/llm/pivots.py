"""Near-duplicate vectors by a pivot-permutation index with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.components import connected_components
from docmeter.llm.grouped import forest, group_bounds, two_sided_forest, whole_groups
from docmeter.llm.hot import join_by_key
from docmeter.llm.textbytes import sliced
from docmeter.llm.workspace import drop, stored

LEAST_COSINE = 0.93
#: Nearest reference points that describe a vector.
PREFIX = 12
#: Reference points of a label: the power of two from one for each so many of its vectors, within bounds. Drawn pairs at
#: cosine .93 in 2, 16, 64 and 768 dimensions: 128 to 4,096 points lose none of 20,000 for want of a shared one.
VECTORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 128, 4096
#: A label whose lists hold this many times all its pairs is compared whole, in one list of this pivot number.
CROWDED, EVERY = 2, -1
#: Vectors of one list in one block: an eighth of the list within these bounds. How many meet another block's at a time.
BLOCKS, STRIP = (1024, 4096), 512


def _pivots_for(dimension: int, number: int) -> np.ndarray:
    """Reference points: normal draws, the same first ones for any number.

    Draws are not scaled to unit length: two vectors' products with them then have the vectors' cosine as correlation,
    whatever the dimension and however the table's vectors crowd.
    """
    return np.random.default_rng(dimension).normal(size=(number, dimension))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each vector is there, has finite components only, and is not zero."""
    for batch in batches:
        vector = batch.column(2)
        size = pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vector.flatten()
        value = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(row[~np.isfinite(value)], minlength=len(size)) > 0
        some = np.bincount(row[np.isfinite(value) & (value != 0)], minlength=len(size)) > 0
        yield pa.record_batch([*batch.columns, pa.array(some & ~bad)], [*batch.schema.names, "usable"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the PREFIX nearest reference points of each vector, nearest first."""
    product = _unit(vectors) @ pivots.T
    top = np.argpartition(-product, PREFIX - 1, axis=1)[:, :PREFIX]
    order = np.lexsort((top, -np.take_along_axis(product, top, axis=1)), axis=1)
    return np.take_along_axis(top, order, axis=1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with its nearest pivots, nearest first."""
    tables: dict[tuple[int, int], np.ndarray] = {}
    for batch in sliced(batches, 512):
        size, number = pc.list_value_length(batch.column("embedding")).to_numpy(), batch.column("n_pivots").to_numpy()
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        end = np.cumsum(size)
        order = np.zeros((len(size), PREFIX), np.int16)
        for d, k in set(zip(size.tolist(), number.tolist(), strict=True)):
            if (d, k) not in tables:
                tables[d, k] = _pivots_for(d, k)
            rows = np.flatnonzero((size == d) & (number == k))
            order[rows] = nearest_pivots(flat[(end[rows] - d)[:, None] + np.arange(d)], tables[d, k])
        pivots = pa.ListArray.from_arrays(np.arange(0, order.size + 1, PREFIX, dtype=np.int32), pa.array(order.ravel()))
        yield pa.record_batch([*batch.columns, pivots], [*batch.schema.names, "pivots"])


def _flat(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _first_here(x: np.ndarray, y: np.ndarray, last: int) -> np.ndarray:
    """Whether two vectors share no pivot below ``last``: then no other list that both are in comes before."""
    below = np.unique(np.concatenate([x[x < last], y[y < last]]))
    shared = np.zeros((len(x), len(y)), np.float32)
    if len(below):
        has = []
        for side in (x, y):
            at = np.minimum(np.searchsorted(below, side), len(below) - 1)
            table = np.zeros((len(side), len(below)), np.float32)
            row, col = np.nonzero(below[at] == side)
            table[row, at[row, col]] = 1
            has.append(table)
        shared = has[0] @ has[1].T
    return shared == 0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in each pair of blocks of a list: per vector their weight and the smallest row that they reach.

    A pair counts in the first list that both are in, and only there; in a list of EVERY always.
    """
    for rows, group in whole_groups(batches, ["list", "i", "j"]):
        for lo, hi in group_bounds(group):
            part = rows.slice(lo, hi - lo)
            own, block, weight = (part.column(x).to_numpy() for x in ("own", "block", "weight"))
            last, one = part.column("last")[0].as_py(), part.column("i")[0] == part.column("j")[0]
            unit, pivots = _unit(_flat(part.column("embedding"), len(own)).astype(np.float64)), _flat(part.column("pivots"), len(own))
            left = np.arange(len(own)) if one else np.flatnonzero(block == part.column("i")[0].as_py())
            right = left if one else np.flatnonzero(block == part.column("j")[0].as_py())
            link = np.zeros((len(left), len(right)), bool)
            for a in range(0, len(left), STRIP):
                x = left[a : a + STRIP]
                near = unit[x] @ unit[right].T >= LEAST_COSINE
                if one:
                    near[np.arange(len(x)), a + np.arange(len(x))] = False
                if last != EVERY:
                    r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    near[np.ix_(r, c)] &= _first_here(pivots[x[r]], pivots[right[c]], last)
                link[a : a + STRIP] = near
            r, c = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
            link = link[np.ix_(r, c)]
            to_left, to_right = (forest(link), None) if one else two_sided_forest(link)
            node = np.concatenate([left[r], right[c]])
            links = [link.astype(np.float32) @ weight[right[c]], link.T.astype(np.float32) @ weight[left[r]]]
            sides = [(left[r], links[0], to_left)] if one else [(left[r], links[0], to_left), (right[c], links[1], to_right)]
            for at, n, reached in sides:
                yield pa.record_batch([pa.array(own[at]), pa.array(np.rint(n).astype(np.int64)), pa.array(own[node[reached]])], ["own", "links", "other"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", vectors_a_pivot: int = VECTORS_A_PIVOT, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """Vectors of equal label that link at cosine >= LEAST_COSINE in double precision.

    Returns one row per input row: ``vec_id, n_links`` (other rows linked directly), ``component_id`` (smallest id
    reachable by links, itself included), ``kept`` (vec_id = component_id). Vectors that are null, empty or zero, that
    hold null or non-finite components, or that have no label link with nothing; vectors of different lengths neither.
    Equal vectors of a label link with each other and are searched as one. Repeated ids keep a row each, with the links
    of its own vector; a row with a null id keeps a row and takes the group of a vector that it copies. Other columns
    are not read; an empty table gives an empty one.

    A label has pivots in proportion to its vectors, so that a list stays about as long as it is until MOST_PIVOTS. All
    vectors that share a pivot are compared, each two in one list, whatever the label's size. A label whose vectors crowd into the same lists, so that these hold CROWDED times its
    pairs or more, is compared whole instead. Lists are cut into blocks, and each pair of blocks is compared in a group
    of its own, so that a long list never meets in one task; links leave the task as one count and one link per vector.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("embedding"))
    rows = rows.mapInArrow(_usable, f"vec_id long, label string, embedding {kind}, usable boolean")
    usable = F.col("usable") & F.col("label").isNotNull()
    hashes = {"hash_a": F.when(usable, F.xxhash64("embedding")), "hash_b": F.when(usable, F.xxhash64(F.lit(1), F.reverse("embedding")))}
    rows = stored(rows.withColumns(hashes).withColumn("embedding", F.when(usable, F.col("embedding"))).drop("usable").withColumn("row", F.monotonically_increasing_id()), "pivot-vectors")
    same = ["label", "hash_a", "hash_b"]
    classes = rows.filter("hash_a is not null and vec_id is not null").groupBy(*same)
    classes = classes.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumns({"own": F.monotonically_increasing_id(), "size": F.size("embedding")}), "pivot-classes")

    group = ["label", "size"]
    power = F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / vectors_a_pivot))).cast("int")
    plan = classes.groupBy(*group).agg(F.count("*").alias("n"))
    plan = plan.select(*group, F.greatest(F.lit(LEAST_PIVOTS), F.least(F.lit(MOST_PIVOTS), power)).alias("n_pivots"))
    described = join_by_key(classes.select("own", "embedding", "label", "size", "weight"), plan, group, ["own"])
    described = described.select("own", "embedding", "label", "size", "weight", "n_pivots")
    index = stored(described.mapInArrow(_described, f"own long, embedding {kind}, label string, size int, weight long, n_pivots int, pivots array<smallint>"), "pivot-index")

    singles = F.transform("pivots", lambda p: F.struct(p.cast("int").alias("last"), F.xxhash64("label", "size", p).alias("list")))
    lists = index.withColumn("lists", singles)
    load = lists.select(*group, F.explode("lists.list").alias("list")).groupBy(*group, "list").agg(F.count("*").cast("double").alias("n"))
    load = load.groupBy(*group).agg((F.sum(F.col("n") * F.col("n")) >= CROWDED * F.pow(F.sum("n") / PREFIX, F.lit(2))).alias("crowded"))
    whole = F.array(F.struct(F.lit(EVERY).alias("last"), F.xxhash64("label", "size").alias("list")))
    lists = join_by_key(lists, load, group, ["own"]).select("own", "weight", "pivots", "embedding", F.inline(F.when(F.col("crowded"), whole).otherwise(F.col("lists"))))
    lengths = lists.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    lengths = lengths.select("list", F.ceil(F.col("n") / F.greatest(F.lit(blocks[0]), F.least(F.lit(blocks[1]), F.col("n") / 8))).cast("int").alias("blocks"))
    lists = join_by_key(lists, lengths, ["list"], ["own"]).withColumn("block", F.pmod(F.xxhash64("own"), "blocks").cast("int"))
    lists = lists.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.select("list", F.least("block", "meets").alias("i"), F.greatest("block", "meets").alias("j"), "block", "last", "own", "weight", "pivots", "embedding")
    lists = lists.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    found = stored(lists.mapInArrow(_compared, "own long, links long, other long"), "pivot-links")

    links = found.groupBy("own").agg(F.sum("links").alias("links"))
    labels = connected_components(found, "own", "other").withColumnRenamed("node", "own")
    drop(index)
    named = classes.select("own", "vec_id", "weight", *same).join(links, "own", "left").join(labels, "own", "left").withColumn("component", F.coalesce("component", "own"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = join_by_key(named, least, ["component"], ["own"]).select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = join_by_key(rows.select("vec_id", "row", *same), named, same, ["row"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), v AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / m) AS e FROM u
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {LEAST_COSINE}
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
