"""Packing of documents into fixed-length sequences by cutting-stock column generation over the length histogram."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.llm.textbytes import sliced, steps, text_buffers
from docmeter.llm.tokens import default_path, word_tokenizer
from docmeter.llm.workspace import stored

SEQUENCE = 2048
END_ID = 1
#: Lengths are rounded up to multiples of this for the linear program; at most GRAIN - 1 ids of padding a piece follow.
GRAIN = 8
#: The program stops once a new pattern would save less than this share of a sequence, or after so many patterns.
TOLERANCE, MOST_PATTERNS = 1e-6, 20_000


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the dearest multiset of sizes (ascending) that fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            value = best[c - sizes[: fits[c]]] + prices[: fits[c]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c:
        k = choice[c]
        if k < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= sizes[k]
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which pattern (pieces of each size) so that every demanded piece has one place.

    Revised simplex on the covering program, columns priced by the knapsack; the solution is rounded down and what is
    left, under one sequence for each size, goes into bins by first fit of decreasing sizes.
    """
    if not len(sizes):
        return []
    most = capacity // sizes
    columns = np.diag(most)
    inverse, use = np.diag(1.0 / most), demand / most
    for _ in range(MOST_PATTERNS):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + TOLERANCE:
            break
        step = inverse @ pattern
        ratio = np.full(len(use), np.inf)
        up = step > 1e-9
        ratio[up] = np.maximum(use[up], 0) / step[up]
        leaves = int(ratio.argmin())
        row = inverse[leaves] / step[leaves]
        use = use - ratio[leaves] * step
        use[leaves] = ratio[leaves]
        inverse = inverse - np.outer(step, row)
        inverse[leaves] = row
        columns[:, leaves] = pattern
    left, out = demand.copy(), []
    for k in np.argsort(-use):
        pattern = columns[:, k]
        times = max(0, min(int(use[k] + 1e-9), *(left[pattern > 0] // pattern[pattern > 0]).tolist()))
        if times:
            out.append((times, pattern.copy()))
            left -= times * pattern
    bins: list[tuple[int, np.ndarray]] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(left[k]):
            at = next((i for i, (room, _) in enumerate(bins) if room >= sizes[k]), None)
            if at is None:
                at = len(bins)
                bins.append((capacity, np.zeros(len(sizes), np.int64)))
            room, pattern = bins[at]
            pattern[k] += 1
            bins[at] = (room - sizes[k], pattern)
    return [*out, *((1, p) for _, p in bins)]


def _runs(histogram: dict[int, int], capacity: int) -> list[dict]:
    """Ranges of ranks of each size, and the sequences that they go to: ``each`` pieces to one sequence after another."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    cursor, first, out = np.zeros(len(sizes), np.int64), 0, []
    for times, pattern in cutting_stock(sizes, demand, capacity):
        for k in np.flatnonzero(pattern).tolist():
            each = int(pattern[k])
            out.append({"size": int(sizes[k]), "lo": int(cursor[k]), "hi": int(cursor[k]) + times * each, "each": each, "first": first})
            cursor[k] += times * each
        first += times
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, sequence: int, grain: int) -> Iterator[pa.RecordBatch]:
    encode, part = word_tokenizer(path), TaskContext.get().partitionId()
    seen = np.zeros(-(-sequence // grain) + 1, np.int64)
    for batch in sliced(batches):
        data, bounds = text_buffers(batch.column(1))
        for lo, hi in steps(bounds):
            ids, counts = encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            ids = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4")
            tokens = counts + 1
            number = -(-tokens // sequence)
            doc = np.repeat(np.arange(hi - lo), number)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * sequence
            length = np.minimum(tokens[doc] - start, sequence)
            place = (np.cumsum(tokens) - tokens)[doc] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
            size = -(-length // grain)
            order = np.argsort(size, kind="stable")
            head = np.searchsorted(size[order], size[order])
            rank = np.empty(len(size), np.int64)
            rank[order] = seen[size[order]] + np.arange(len(size)) - head
            seen += np.bincount(size, minlength=len(seen))
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[doc])), pa.array(size, pa.int32()), pa.array(np.full(len(size), part), pa.int32()), pa.array(rank, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "rank"],
            )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``sequence`` ids.

    A document is the ids of its whole text and END_ID; a null or empty text is END_ID alone. Documents are cut every
    ``sequence`` ids, and only there. Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one
    row per piece; sequence ids count from 0, offsets are gapless. Very long texts are tokenised in steps and have many
    pieces; ties in size are ranked in the order of rows. Repeated and null ids are packed like others; other
    columns are not read; an empty table gives no piece.

    Each task ranks its own pieces of each size; ranks of the whole table follow from counts per task and size, so that
    a size with most of the rows meets in no task. Only the histogram of sizes reaches the driver, and the plan that goes
    back has a few rows for each size, whatever the input.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(lambda batches: _pieces(batches, path, sequence, grain), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, part int, rank long")
    pieces = stored(pieces, "pack-pieces")
    counts = pieces.groupBy("part", "size").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}

    runs = json.dumps(_runs(histogram, sequence // grain))
    runs = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(runs), "array<struct<size int, lo bigint, hi bigint, each bigint, first bigint>>")))
    ranked = pieces.join(before, ["part", "size"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "size").filter("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.expr("first + (rank - lo) div each"))
    above = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(above), F.lit(0))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, as ``pack`` gives them: null and empty texts are one piece of the end id alone, very long ones
    many pieces, repeated and null ids are packed like others, columns of any name are not read, and an empty table gives
    no row."""
    return pack(docs)
