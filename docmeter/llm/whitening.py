"""Whitened leading components of vectors by Chebyshev-filtered subspace iteration over distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.textbytes import sliced
from docmeter.llm.workspace import stored

COMPONENTS = 8
#: Columns that are iterated: four for each component wanted, so that the ones left out lie well below.
BLOCK = 4 * COMPONENTS
#: Products in one round of filtering and Rayleigh-Ritz.
DEGREE = 10
#: Largest residual, as a part of the largest eigenvalue, at which a component is certified; what is accepted once rounding
#: lets no round halve it; rounds before giving up.
CERTIFIED, ACCEPTED, MOST_ROUNDS = 1e-13, 1e-9, 200
#: Components of less than this part of the largest eigenvalue have no variance but rounding.
LEAST_PART = 1e-12
#: Whole numbers that doubles hold exactly: entries that would become larger ones make a vector unusable.
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class Centre:
    """The exact mean of whole-number vectors: sum, count, whole part and rest of sum / count."""

    n: int
    total: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.total], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.total], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n


def _matrices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in sliced(batches, rows):
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _cells(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row for each number of a task's matrix."""
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])


def _summed(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' matrices; only one number a cell reaches the driver."""
    out = np.zeros(shape[0] * shape[1])
    for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(shape)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each dimension's sum in two halves, which no task's rows can make overflow."""
    total = None
    for _, x in _matrices(batches):
        part = np.stack([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])
        total = part if total is None else total + part
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(total.shape[1])), pa.array(total[0]), pa.array(total[1])], ["dim", "high", "low"])


def _product(rows: DataFrame, centre: Centre, q: np.ndarray) -> np.ndarray:
    """V q, where V is the covariance: one pass that never holds V."""
    sent = rows.sparkSession.sparkContext.broadcast((centre, q))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, (centre, q) = None, sent.value
        for _, x in _matrices(batches):
            x = centre.centred(x)
            part = x.T @ (x @ q)
            total = part if total is None else total + part
        yield from _cells(total)

    out = _summed(rows.select("x").mapInArrow(multiplied, "cell long, value double"), q.shape) / centre.n
    sent.destroy()
    return out


def subspace(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, block: int = BLOCK, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and unit eigenvectors (columns) of a covariance given by its products.

    Each round applies a Chebyshev polynomial of ``degree`` that stays below 1 in size between 0 and the block's smallest
    Ritz value and grows fast above, then QR and Rayleigh-Ritz, until the residual of every wanted pair is certified. A
    block as wide as the space is exact after one product.
    """
    wanted, block = min(wanted, dimension), min(dimension, max(block, 2 * wanted))
    q = np.linalg.qr(np.random.default_rng(dimension).normal(size=(dimension, block)))[0]
    best = np.inf
    for _ in range(MOST_ROUNDS):
        y = product(q)
        value, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residual = np.linalg.norm(y[:, :wanted] - q[:, :wanted] * value[:wanted], axis=0).max()
        scale = max(value[0], np.finfo(float).tiny)
        if residual <= CERTIFIED * scale or block == dimension or (residual <= ACCEPTED * scale and residual > best / 2):
            return value[:wanted], q[:, :wanted]
        best = min(best, residual)
        half = max(value[-1], 1e-6 * scale) / 2
        before, now = q, (y - half * q) / half
        for _ in range(degree - 2):
            size = np.linalg.norm(now, axis=0)
            before, now = before / size, now / size
            before, now = now, 2 / half * (product(now) - half * now) - before
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
    raise ArithmeticError(f"no certified components after {MOST_ROUNDS} rounds")


def _deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Sum over dimensions of (n x - S) squared, exact; null where it is no long."""
    shift = x - centre.whole
    if x.shape[1] * (centre.n * (float(np.abs(shift).max(initial=0)) + 1)) ** 2 < 2.0**62:
        return pa.array(((centre.n * shift - centre.rest) ** 2).sum(axis=1))
    exact = ((centre.n * shift.astype(object) - centre.rest.astype(object)) ** 2).sum(axis=1)
    return pa.array([v if v < 1 << 63 else None for v in exact.tolist()], pa.int64())


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Leading whitened components of all vectors, each entry c first made the whole number floor(1024 c) + 100000.

    Returns for each vector and each component, by falling eigenvalue e: ``vec_id, component`` (from 1), ``n`` (vectors),
    ``deviation`` (sum over dimensions of (n x - S) squared, S their sums; exact, null where no long can hold it),
    ``whitened`` (x - S / n on the component, over the root of e), ``explained`` (e over the covariance's trace),
    ``identity_error`` (largest entry of whitened's covariance minus the identity, from a pass of its own).

    Left out: vectors that are null or empty, that hold null or non-finite entries or ones beyond 2^53 once they are whole
    numbers, and vectors of another length than the most frequent one (of several, the shortest). Components without
    variance have no rows, so that one vector, equal vectors and an empty table give none; fewer dimensions than
    ``components`` give as many. Equal rows and repeated or null ids keep rows of their own. Equal eigenvalues: any
    orthonormal basis of their space. Other columns are not read.

    The whole numbers are stored once. Each product is one pass that leaves dimension times ``block`` sums; the driver holds
    matrices of that size and never V. A lost executor costs its tasks of the pass at hand.
    """
    spark = vectors.sparkSession
    of = lambda c: F.floor(F.lit(1024.0) * c) + F.lit(100000)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(1024.0) * c) < F.lit(_EXACT - 2e5))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") > 0) & F.forall("v", fits)).select("vec_id", F.transform("v", of).alias("x"))
    rows = stored(rows, "whitening-rows")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], _RESULT)
    dimension, n = sizes[0].d, sizes[0].n
    rows = rows.filter(F.size("x") == dimension)

    whole = "decimal(38,0)"
    sums = rows.select("x").mapInArrow(_totals, "dim long, high long, low long").groupBy("dim")
    sums = {r.dim: (int(r.high) << 26) + int(r.low) for r in sums.agg(F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low")).collect()}
    centre = Centre(n, [sums[d] for d in range(dimension)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            part = (centre.centred(x) ** 2).sum(axis=0)
            total = part if total is None else total + part
        yield from _cells(total)

    trace = _summed(rows.select("x").mapInArrow(spread, "cell long, value double"), (1, dimension)).sum() / n
    value, q = subspace(lambda q: _product(rows, centre, q), dimension, components, block)
    some = value > max(LEAST_PART * value[0], 0)
    value, turn = value[some], q[:, some] / np.sqrt(value[some])
    if not len(value):
        return spark.createDataFrame([], _RESULT)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            w = centre.centred(x) @ turn
            total = w.T @ w if total is None else total + w.T @ w
        yield from _cells(total)

    k = len(value)
    covariance = _summed(rows.select("x").mapInArrow(squared, "cell long, value double"), (k, k)) / n
    error = float(np.abs(covariance - np.eye(k)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches):
            w = centre.centred(x) @ turn
            row = np.repeat(np.arange(len(x)), k)
            columns = [batch.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), n)), _deviations(x, centre).take(pa.array(row))]
            columns += [pa.array(w.ravel()), pa.array(np.tile(value / trace, len(x))), pa.array(np.full(len(row), error))]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
