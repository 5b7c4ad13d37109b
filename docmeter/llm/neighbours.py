"""Nearest vectors through low-dimensional stable projections, a kd-tree over them and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.llm.grouped import group_bounds, whole_groups
from docmeter.llm.hot import join_by_key
from docmeter.llm.textbytes import sliced
from docmeter.llm.workspace import drop, stored

NEAREST, QUERIES_EVERY = 10, 100
#: Dimensions of the projection (even), and the chance with which each true neighbour is found, however the vectors lie.
DIMENSIONS, CERTAINTY = 16, 0.98
#: The upper tree: vectors of a cell aimed at, cells at most, and vectors of the sample that its planes are fitted on (about
#: SAMPLE of them, picked by hash). Every vector is indexed.
CELL_ROWS, MOST_CELLS, SAMPLE = 4096, 1024, 32_768
#: Cells are dealt into blocks of so many vectors or numbers; a block meets so many queries in one group.
BLOCK_ROWS, BLOCK_NUMBERS, PART_QUERIES = 16_384, 1 << 22, 16_384
#: Vectors in a leaf of a block's own tree; queries that search it together.
LEAF, TOGETHER = 128, 1024
#: Parts of a class of equal vectors whose smallest ids are found first.
SALTS = 64
_EPS = np.finfo(np.float64).eps


def chi_square_quantile(p: float, dimensions: int = DIMENSIONS) -> float:
    """The value below which a chi-square variable of an even number of degrees of freedom lies with chance ``p``."""

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, dimensions // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return hi


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision, squares added up in the order of the dimensions; scaled where squares
    would overflow or vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        diff = x - y
        out = np.sqrt(np.add.accumulate(diff * diff, axis=1)[:, -1])
        odd = np.flatnonzero(~((out > 1e-140) & np.isfinite(out)))
        top = np.abs(diff[odd]).max(axis=1, initial=0)
        safe = np.where((top > 0) & np.isfinite(top), top, 1)[:, None]
        out[odd] = np.sqrt(((diff[odd] / safe) ** 2).sum(axis=1)) * np.where(top > 0, safe[:, 0], 0)
    return out


def _flat(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


# ------------------------------------------------------------------------------------------------ upper tree over all vectors


@dataclass
class Cells:
    """Vectors of one length: planes of a whole binary tree in heap order, its cells' boxes, and their blocks."""

    dim: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(len(self.low).bit_length() - 1):
            node = 2 * node + (p[np.arange(len(p)), self.dim[node]] > self.value[node])
        return node - len(self.low)


@dataclass
class UpperTree:
    """Cells by vector length. Lengths that the sample has none of are one cell."""

    by_size: dict[int, Cells] = field(default_factory=dict)
    unseen_rows: float = 0.0

    def __getitem__(self, size: int) -> Cells:
        if size not in self.by_size:
            self.by_size[size] = fitted(np.zeros((0, DIMENSIONS)), size, 1, 1, self.unseen_rows)
        return self.by_size[size]


def fitted(sample: np.ndarray, size: int, cells: int, weight: float, rows: float | None = None) -> Cells:
    """Median planes over the widest dimension of each node; each sampled vector stands for ``weight`` vectors."""
    dim, value = np.zeros(cells, np.int64), np.zeros(cells)
    low, high = np.full((2 * cells, DIMENSIONS), -np.inf), np.full((2 * cells, DIMENSIONS), np.inf)
    inside = {1: sample}
    for node in range(1, cells):
        here = inside.pop(node)
        finite = np.where(np.isfinite(here), here, 0)
        d = int(np.argmax(np.ptp(finite, axis=0))) if len(here) else 0
        dim[node], value[node] = d, np.median(finite[:, d]) if len(here) else 0
        for child, side in ((2 * node, finite[:, d] <= value[node]), (2 * node + 1, finite[:, d] > value[node])):
            inside[child] = here[side]
            low[child], high[child] = low[node], high[node]
        high[2 * node, d] = low[2 * node + 1, d] = value[node]
    count = np.array([rows if rows is not None else len(inside[cells + c]) * weight for c in range(cells)])
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(size, 1)))
    return Cells(dim, value, low[cells:], high[cells:], np.maximum(1, np.ceil(count / most)).astype(np.int64))


def _box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box; not a number, which prunes nothing, where rows are not finite."""
    out = np.zeros((len(p), len(low)))
    with np.errstate(invalid="ignore", over="ignore"):
        for d in range(p.shape[1]):
            x = p[:, d : d + 1]
            out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


_projections: dict[int, np.ndarray] = {}


def projected(vectors: np.ndarray) -> np.ndarray:
    """Products with normal draws: their squared differences are the vectors' ones times a chi-square variable."""
    d = vectors.shape[1]
    if d not in _projections:
        _projections.clear()
        _projections[d] = np.random.default_rng(d).normal(size=(d, DIMENSIONS))
    with np.errstate(over="ignore", invalid="ignore"):
        return (vectors @ _projections[d]).astype(np.float32)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    size = batch.column("size").to_numpy()
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, batch.take(pa.array(at))


def _lists(table: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), pa.array(table.ravel()))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for _, at, rows in _by_size(batch):
            yield pa.record_batch([*rows.columns, _lists(projected(_flat(rows.column("embedding"), len(at))))], [*rows.schema.names, "projected"])


# ------------------------------------------------------------------------------------------------ search within one block


class Tree:
    """A kd-tree over projected vectors: leaves of at most LEAF rows, each with its box."""

    def __init__(self, p: np.ndarray):
        finite = np.where(np.isfinite(p), p, 0)
        leaves, todo = [], [np.arange(len(p))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            d = int(np.argmax(np.ptp(finite[at], axis=0)))
            half = len(at) // 2
            order = np.argpartition(finite[at, d], half)
            todo += [at[order[half:]], at[order[:half]]]
        self.leaves = [np.sort(x) for x in leaves]
        self.low, self.high = np.stack([p[x].min(axis=0) for x in leaves]), np.stack([p[x].max(axis=0) for x in leaves])


class Block:
    """Vectors of one block, in the order of their smallest id, with the number of rows that each stands for."""

    def __init__(self, vectors: np.ndarray, p: np.ndarray, weight: np.ndarray, keep: int, certainty: float):
        self.v, self.p, self.weight, self.keep = vectors, p, weight, keep
        self.tree, self.stop = Tree(p), chi_square_quantile(certainty)
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = (vectors * vectors).sum(axis=1)
        self.verified = 0

    def search(self, q: np.ndarray, p: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 where there are fewer) and distances of the ``keep`` nearest vectors found for each query.

        Leaves come by their projected distance, twice as many in each round. A query stops once the chi-square test
        holds: a vector as near as the ``keep``-th row so far (or as ``most``, from elsewhere) would lie as far away in
        projection as the next leaf with chance 1 - certainty at most.
        """
        best, best_at = np.full((len(q), self.keep), np.inf), np.full((len(q), self.keep), -1)
        limit = most.copy()
        box = _box_distances(p, self.tree.low, self.tree.high)
        order = np.argsort(box, axis=1)
        norm = (q * q).sum(axis=1)
        lo, width = 0, 1
        while lo < order.shape[1]:
            leaf = order[:, lo : lo + width]
            with np.errstate(over="ignore", invalid="ignore"):
                go = ~(np.take_along_axis(box, leaf, axis=1) > self.stop * (limit * limit)[:, None])
            if not go.any():
                break
            row, col = np.nonzero(go)
            leaf = leaf[row, col]
            by_leaf = np.argsort(leaf, kind="stable")
            row, leaf = row[by_leaf], leaf[by_leaf]
            found = [self._leaf(self.tree.leaves[leaf[a]], row[a:b], q, p, norm, limit) for a, b in group_bounds(leaf)]
            self._merge(q, np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), best, best_at)
            rows = np.where(best_at >= 0, self.weight[best_at], 0).cumsum(axis=1)
            enough = np.where(rows >= self.keep, best, np.inf).min(axis=1)
            limit = np.minimum(limit, enough)
            lo, width = lo + width, 2 * width
        return best_at, best

    def _leaf(self, leaf: np.ndarray, rows: np.ndarray, q: np.ndarray, p: np.ndarray, norm: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of queries and vectors of a leaf that may be among the nearest: bounds leave out only what cannot be."""
        out_q, out_v = [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for a in range(0, len(rows), 512):
                r = rows[a : a + 512]
                near = ((p[r] ** 2).sum(axis=1)[:, None] + (self.p[leaf] ** 2).sum(axis=1)) - 2 * (p[r] @ self.p[leaf].T)
                cut = (limit[r] * limit[r])[:, None]
                may = ~(near * (1 - 1e-6) > self.stop * cut + 1e-6 * (p[r] ** 2).sum(axis=1)[:, None])
                both = norm[r][:, None] + self.norm[leaf]
                square, slack = both - 2 * (q[r] @ self.v[leaf].T), 4 * (q.shape[1] + 8) * _EPS * both
                if len(leaf) > self.keep:
                    upper = np.where(may, square + slack, np.inf)
                    cut = np.fmin(cut, np.partition(upper, self.keep - 1, axis=1)[:, self.keep - 1 : self.keep])
                i, j = np.nonzero(may & ~(square - slack > cut * (1 + 1e-12)))
                self.verified += len(i)
                out_q.append(r[i])
                out_v.append(leaf[j])
        return np.concatenate(out_q), np.concatenate(out_v)

    def _merge(self, q: np.ndarray, row: np.ndarray, at: np.ndarray, best: np.ndarray, best_at: np.ndarray) -> None:
        exact = np.empty(len(row))
        for a in range(0, len(row), step := max(1, (1 << 20) // q.shape[1])):
            exact[a : a + step] = distances(self.v[at[a : a + step]], q[row[a : a + step]])
        touched = np.unique(row)
        old_row, old_col = np.nonzero(best_at[touched] >= 0)
        row = np.concatenate([row, touched[old_row]])
        at = np.concatenate([at, best_at[touched[old_row], old_col]])
        exact = np.concatenate([exact, best[touched[old_row], old_col]])
        order = np.lexsort((at, exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        some = place < self.keep
        best[row[some], place[some]], best_at[row[some], place[some]] = exact[some], at[some]


def _searched(batches: Iterator[pa.RecordBatch], keep: int, certainty: float) -> Iterator[pa.RecordBatch]:
    """The ``keep`` nearest rows of a block for each query of its part: one row for each."""
    for rows, group in whole_groups(batches, ["size", "cell", "block", "part"]):
        for a, b in group_bounds(group):
            one = rows.slice(a, b - a).combine_chunks()
            asked = one.column("asked").to_numpy()
            n = int(np.searchsorted(asked, True))  # candidates stand first
            if not 0 < n < len(asked):
                continue
            there, members = one.slice(0, n), one.column("members").slice(0, n).combine_chunks()
            flat, start = members.flatten(), np.append(0, np.cumsum(members.value_lengths().to_numpy()))
            vec_id, row = flat.field("vec_id").to_numpy(), flat.field("row").to_numpy()
            order = np.lexsort((row[start[:-1]], vec_id[start[:-1]]))
            start, weight = start[:-1][order], np.diff(start)[order]
            block = Block(_flat(there.column("embedding"), n)[order], _flat(there.column("projected"), n)[order], weight, keep, certainty)
            for lo in range(n, len(asked), TOGETHER):
                some = one.slice(lo, min(TOGETHER, len(asked) - lo))
                m = some.num_rows
                at, far = block.search(_flat(some.column("embedding"), m), _flat(some.column("projected"), m), some.column("most").to_numpy())
                r, c = np.nonzero(at >= 0)
                each = weight[at[r, c]]
                r, c = np.repeat(r, each), np.repeat(c, each)
                nth = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each)
                where = start[at[r, c]] + nth
                order = np.lexsort((row[where], vec_id[where], far[r, c], r))
                r, c, where = r[order], c[order], where[order]
                near = np.arange(len(r)) - np.searchsorted(r, r) < keep
                r, c, where = r[near], c[near], where[near]
                own = some.column("own").to_numpy()[r]
                yield pa.record_batch([pa.array(own), pa.array(far[r, c]), pa.array(vec_id[where]), pa.array(row[where])], ["own", "score", "vec_id", "row"])


# ------------------------------------------------------------------------------------------------ the search as a whole

_KEYS = ["size", "cell", "block", "part"]


def nearest_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries_every: int = QUERIES_EVERY, nearest: int = NEAREST, certainty: float = CERTAINTY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``nearest`` other vectors by Euclidean distance of each vector whose id is divisible by ``queries_every``.

    Returns ``query_id, rank`` (from 1), ``vec_id, score`` (distance in double precision), nearest first, ties to the
    smaller id. A query with fewer candidates gets all of them. Each true neighbour is found with chance ``certainty`` or
    more. Rows take no part whose id is null or whose vector is null, empty or zero or holds null or non-finite
    components; vectors of different lengths do not meet. Repeated ids are rows of their own, each both candidate and, if
    divisible, query; only the query's own row is left out. Other columns are not read; an empty table gives an empty one.

    Equal vectors become one class that keeps its ``nearest`` + 1 smallest ids, which are all that any answer can hold, and
    is searched once. Classes are projected and dealt by an upper tree into cells, and cells into blocks, each with a
    kd-tree of its own. A query first searches one block of its own cell; what it finds bounds its last neighbour's
    distance, so that the stopping test can leave out whole cells before it visits the others, leaf by leaf. The planes are
    fitted on a bounded sample; the tree that tasks read has at most MOST_CELLS cells for each length in it. No group
    holds more than a block and PART_QUERIES queries.
    """
    keep = nearest + 1
    kind = "array<float>" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "array<double>"
    v = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.forall(v, finite) & F.exists(v, lambda c: c != 0))
    rows = stored(rows.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"), F.xxhash64(v).alias("hash_a"), F.xxhash64(F.lit(1), F.reverse(v)).alias("hash_b")), "neighbour-vectors")
    same = ["hash_a", "hash_b"]
    asked = rows.filter(F.col("vec_id") % queries_every == 0).select(*same, "vec_id", "row")

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    first = Window.partitionBy(*same, "salt").orderBy("vec_id", "row")
    few = salted.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep)
    member = F.struct("vec_id", "row")
    few = few.groupBy(*same, "salt").agg(F.first("embedding").alias("embedding"), F.collect_list(member).alias("members"))
    classes = few.groupBy(*same).agg(F.first("embedding").alias("embedding"), F.slice(F.array_sort(F.flatten(F.collect_list("members"))), 1, keep).alias("members"))
    classes = classes.join(asked.select(*same).distinct().withColumn("is_query", F.lit(True)), same, "left")
    columns = f"own long, hash_a long, hash_b long, size int, is_query boolean, members array<struct<vec_id:long,row:long>>, embedding {kind}"
    classes = classes.select(F.monotonically_increasing_id().alias("own"), *same, F.size("embedding").alias("size"), F.coalesce("is_query", F.lit(False)).alias("is_query"), "members", "embedding")
    classes = stored(classes.mapInArrow(_project, f"{columns}, projected array<float>"), "neighbour-classes")
    tree = rows.sparkSession.sparkContext.broadcast(_upper_tree(classes, cell_rows))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for size, at, part in _by_size(batch):
                cells = tree.value[size]
                cell = cells.of(_flat(part.column("projected"), len(at)))
                blocks = cells.blocks[cell]
                block = (part.column("own").to_numpy() * 0x9E3779B1 >> 16) % blocks
                yield pa.record_batch([*part.columns, *(pa.array(x.astype(np.int32)) for x in (cell, block))], [*part.schema.names, "cell", "block"])

    index = stored(classes.mapInArrow(placed, f"{columns}, projected array<float>, cell int, block int"), "neighbour-index")
    drop(classes)
    queries = index.filter("is_query").select("own", "size", "cell", "block", "embedding", "projected")
    load = queries.groupBy("size", "cell").agg(F.ceil(F.count("*") / PART_QUERIES).alias("parts"))
    part = F.xxhash64("size", "cell", F.pmod(F.xxhash64("own"), "parts"))
    queries = stored(join_by_key(queries, load, ["size", "cell"], ["own"]).select("own", "size", "cell", "block", part.alias("part"), "embedding", "projected"), "neighbour-queries")
    candidates = index.select("size", "cell", "block", F.lit(False).alias("asked"), "own", "members", "embedding", "projected", F.lit(None).cast("double").alias("most"))

    def search(routes: DataFrame) -> DataFrame:
        pairs = routes.select(*_KEYS).distinct()
        meeting = candidates.join(pairs, _KEYS[:3]).select(*_KEYS, "asked", "own", "members", "embedding", "projected", "most")
        asking = routes.select(*_KEYS, F.lit(True).alias("asked"), "own", F.lit(None).cast("array<struct<vec_id:long,row:long>>").alias("members"), "embedding", "projected", "most")
        groups = meeting.unionAll(asking).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "asked")
        return groups.mapInArrow(lambda batches: _searched(batches, keep, certainty), "own long, score double, vec_id long, row long")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = chi_square_quantile(certainty)
        for batch in sliced(batches, 256):
            for size, at, part in _by_size(batch):
                cells, most = tree.value[size], part.column("most").to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    go = ~(_box_distances(_flat(part.column("projected"), len(at)), cells.low, cells.high) > stop * (most * most)[:, None])
                row, cell = np.nonzero(go)
                each = cells.blocks[cell]
                row, cell = np.repeat(row, each), np.repeat(cell, each)
                block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                new = ~((cell == part.column("cell").to_numpy()[row]) & (block == part.column("block").to_numpy()[row]))
                row, cell, block = row[new], cell[new], block[new]
                for lo in range(0, len(row), 4096):
                    some = part.take(pa.array(row[lo : lo + 4096]))
                    some = some.set_column(some.schema.get_field_index("cell"), "cell", pa.array(cell[lo : lo + 4096].astype(np.int32)))
                    yield some.set_column(some.schema.get_field_index("block"), "block", pa.array(block[lo : lo + 4096].astype(np.int32)))

    at_home = stored(search(queries.withColumn("most", F.lit(float("inf")))), "neighbour-first")
    bound = at_home.groupBy("own").agg(F.when(F.count("*") >= keep, F.max("score")).alias("most"))
    bounded = queries.join(bound, "own", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    routes = bounded.select(*_KEYS, "own", "embedding", "projected", "most")
    routes = stored(routes.mapInArrow(routed, f"size int, cell int, block int, part long, own long, embedding {kind}, projected array<float>, most double"), "neighbour-routes")
    found = at_home.unionAll(search(routes)).withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy("score", "vec_id", "row"))).filter(F.col("nth") <= keep)
    found = found.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "row"))).alias("near"))
    found = stored(found.join(index.filter("is_query").select("own", *same), "own").select(*same, "near"), "neighbour-found")
    drop(routes, at_home, queries, index)

    out = join_by_key(asked.select(*same, F.col("vec_id").alias("query_id"), F.col("row").alias("query_row")), found, same, ["query_row"])
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("query_row")), 1, nearest)
    return out.select("query_id", F.posexplode(others).alias("nth", "x")).select("query_id", (F.col("nth") + 1).alias("rank"), "x.vec_id", "x.score")


def _upper_tree(classes: DataFrame, cell_rows: int) -> UpperTree:
    """Cells fitted on about SAMPLE classes, which alone reach the driver."""
    n = classes.count()
    part = min(1.0, SAMPLE / max(n, 1))
    picked = classes.filter(F.pmod(F.xxhash64("own"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("size", "projected").collect()
    tree, by_size = UpperTree(unseen_rows=10 / part), {}
    for r in picked:
        by_size.setdefault(r.size, []).append(r.projected)
    for size, sample in by_size.items():
        cells = min(MOST_CELLS, len(sample) / part / cell_rows, len(sample) / 16)
        tree.by_size[size] = fitted(np.array(sample, np.float64), size, 1 << max(0, math.ceil(math.log2(max(cells, 1)))), 1 / part)
    return tree


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERIES_EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM near
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY rank <= {NEAREST}
"""
