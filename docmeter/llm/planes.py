"""Token ids on disk as shuffled planes: fixed-size blocks, transposed, each plane compressed, with an index of chunks.

A file set is a folder with two Parquet tables, so that any store that Spark can write holds it and lost executors leave
no half files. ``blocks``: one row per block with ``shard, block, n_ids, plane_bytes`` (compressed size of each plane),
``payload`` (the compressed planes, one after the other) and ``doc_ids, doc_starts, doc_tokens`` of the documents that
begin in the block (starts count from the shard's first id). ``index``: one row per shard with ``shard, first_id, n_ids,
n_blocks``. Block b of a shard starts at its id b * BLOCK_IDS. Ids are little-endian unsigned 32-bit integers; plane k
holds bit or byte k of every id of the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.llm.textbytes import steps, text_buffers
from docmeter.llm.tokens import default_path, word_tokenizer
from docmeter.llm.workspace import fresh_path

BLOCK_IDS = 1 << 16
LEVEL = 3
END_ID = 1

_BLOCKS = "shard int, block int, n_ids int, plane_bytes array<int>, payload binary, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Compressed planes of a block: four of bytes, or 32 of bits."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(table, axis=1, bitorder="little").T, axis=1) if bits else table.T
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(payload: bytes, plane_bytes: list[int], n_ids: int) -> np.ndarray:
    """The ids of a block; whether its planes hold bits or bytes follows from their number."""
    unpack = zstandard.ZstdDecompressor().decompress
    cut = np.cumsum([0, *plane_bytes])
    planes = np.stack([np.frombuffer(unpack(payload[a:b]), np.uint8) for a, b in zip(cut, cut[1:], strict=False)])
    if len(planes) == 32:
        planes = np.packbits(np.unpackbits(planes, axis=1, count=n_ids).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _encode(batches: Iterator[pa.RecordBatch], path: str, bits: bool) -> Iterator[pa.RecordBatch]:
    encode, shard = word_tokenizer(path), TaskContext.get().partitionId()
    waiting, n_waiting, block, total = [], 0, 0, 0
    docs = {"doc_ids": [], "doc_starts": [], "doc_tokens": []}

    def row(ids: np.ndarray) -> pa.RecordBatch:
        nonlocal block
        planes = to_planes(ids, bits)
        here = sum(s < (block + 1) * BLOCK_IDS for s in docs["doc_starts"])
        values = {"shard": shard, "block": block, "n_ids": len(ids), "plane_bytes": [len(p) for p in planes], "payload": b"".join(planes)} | {k: v[:here] for k, v in docs.items()}
        for v in docs.values():
            del v[:here]
        block += 1
        return pa.RecordBatch.from_pylist([values], _arrow_blocks())

    for batch in batches:
        data, bounds = text_buffers(batch.column(1))
        names = batch.column(0).to_pylist()
        for lo, hi in steps(bounds):
            ids, counts = encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            ids = np.insert(ids, np.cumsum(counts), END_ID)
            start = total + np.cumsum(counts + 1) - (counts + 1)
            docs["doc_ids"] += names[lo:hi]
            docs["doc_starts"] += start.tolist()
            docs["doc_tokens"] += (counts + 1).tolist()
            total += len(ids)
            waiting.append(ids)
            n_waiting += len(ids)
            if n_waiting >= BLOCK_IDS:
                flat = np.concatenate(waiting)
                whole = n_waiting // BLOCK_IDS * BLOCK_IDS
                for at in range(0, whole, BLOCK_IDS):
                    yield row(flat[at : at + BLOCK_IDS])
                waiting, n_waiting = [flat[whole:]], n_waiting - whole
    if n_waiting:
        yield row(np.concatenate(waiting))


def _arrow_blocks() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("plane_bytes", pa.list_(pa.int32())), ("payload", pa.binary()), ("doc_ids", longs), ("doc_starts", longs), ("doc_tokens", longs)])


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, bits: bool = False) -> None:
    """Encode every whole text, append END_ID to each, and write the ids in ascending order of ``id_col``.

    A null text counts as empty and has the end id alone; a very long one is tokenised in one step and goes over as many
    blocks as it needs; null ids come first; rows with equal ids stay apart, in any
    order among themselves. Rows are dealt by ranges of the id and the row's own number, so that even an id with a third
    of all rows is cut into many shards. Other columns are not read; an empty table gives an empty file set.
    """
    path, spark = tokenizer or default_path(), docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("number"))
    rows = rows.repartitionByRange("doc_id", "number").sortWithinPartitions("doc_id", "number").select("doc_id", "text")
    blocks = rows.mapInArrow(lambda batches: _encode(batches, path, bits), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_blocks"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard: as many as write tasks
    shards.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first_id"), "n_ids", "n_blocks").write.parquet(f"{folder}/index")


def _decode(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents of blocks sorted by shard and block; one that goes on in the next block is carried over."""
    open_: dict | None = None

    def take(ids: np.ndarray) -> np.ndarray:
        part = ids[: open_["left"]]
        open_["crc"] = zlib.crc32(part.tobytes(), open_["crc"])
        open_["left"] -= len(part)
        if with_ids:
            open_["ids"].append(part)
        return ids[len(part) :]

    for batch in batches:
        done = []

        def close() -> None:
            nonlocal open_
            values = [open_["doc_id"], open_["shard"], open_["start"], open_["n"], open_["crc"]]
            done.append([*values, np.concatenate(open_["ids"])] if with_ids else values)
            open_ = None

        for r in batch.to_pylist():
            ids = from_planes(r["payload"], r["plane_bytes"], r["n_ids"])
            if open_:
                ids = take(ids)
                if not open_["left"]:
                    close()
            for doc_id, start, n in zip(r["doc_ids"], r["doc_starts"], r["doc_tokens"], strict=True):
                open_ = {"doc_id": doc_id, "shard": r["shard"], "start": start, "n": n, "left": n, "crc": 0, "ids": []}
                ids = take(ids)
                if not open_["left"]:
                    close()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]
        names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
        yield pa.record_batch([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], names)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a file set: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ``ids``."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").repartition("shard").sortWithinPartitions("shard", "block")
    docs = blocks.mapInArrow(lambda batches: _decode(batches, with_ids), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    index = spark.read.schema("shard int, first_id long, n_ids long, n_blocks long").parquet(f"{folder}/index")
    docs = docs.join(index.select("shard", "first_id"), "shard")
    return docs.select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-planes")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder)
