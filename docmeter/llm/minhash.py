"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.components import connected_components
from docmeter.llm.grouped import forest, group_bounds, whole_groups
from docmeter.llm.hot import join_by_key
from docmeter.llm.textbytes import SPACE, SpanHasher, mixed, sliced, spans, steps, text_buffers, word_sequences
from docmeter.llm.workspace import drop, stored

WORDS = 5
#: Links have 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
#: Places of the two permutations.
UNIVERSE_BITS = 22
#: Values of a signature; the first BANDS * ROWS are banded. A pair at similarity .75 shares no band with chance 5e-6.
COORDINATES, BANDS, ROWS = 256, 32, 4
#: Pairs of one bucket that agree in fewer coordinates are not verified: nine standard deviations below .75, where one
#: of 1e17 pairs lies.
LEAST_AGREEING = 128
#: Rows of one bucket that one task compares with each other at a time.
BLOCK = 512
_GROUP = ["key", "i", "j"]
_ROW = "_row_number"


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one with its head repeated so that each circular shift is one slice."""
    size = 1 << UNIVERSE_BITS
    first, second = (np.random.default_rng(seed).permutation(size).astype(np.uint32) for seed in (3, 7))
    return first, np.concatenate([second, second[:COORDINATES]])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the least value over the set of the second permutation, shifted by k, of the first one."""
    first, second = _permutations()
    shifts = np.lib.stride_tricks.sliding_window_view(second, COORDINATES)
    place = first[shingles & np.uint64(len(first) - 1)]
    out = np.full(COORDINATES, 1 << UNIVERSE_BITS, np.uint32)
    for lo in range(0, len(place), 1024):
        np.minimum(out, shifts[place[lo : lo + 1024]].min(axis=0), out=out)
    return out


def _bands(coordinates: np.ndarray) -> np.ndarray:
    value = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + value[:, k])
    return key.view(np.int64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ASCII-lower-cased words, five in a row, or of all if fewer."""
    data, bounds = text_buffers(column)
    for lo, hi in steps(bounds):
        part = data[bounds[lo] : bounds[hi]]
        start, end, first = spans(SPACE[part], bounds[lo : hi + 1] - bounds[lo])
        word = SpanHasher(part, fold_ascii_case=True)(start, end)
        shingle = word_sequences(word, WORDS)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= WORDS:
                own = np.sort(shingle[a : b - WORDS + 1])
                yield own[np.flatnonzero(np.append(True, own[1:] != own[:-1]))]
            else:
                yield word_sequences(word[a:b], b - a) if b > a else np.zeros(0, np.uint64)


_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        size, set_a, set_b, bands, signatures = [], [], [], [], []
        for own in shingle_sets(batch.column(1)):
            size.append(len(own))
            if len(own):
                coordinates = signature(own)
                set_a.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                set_b.append(int(mixed(own).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(_bands(coordinates))
                signatures.append(coordinates.astype(np.uint8).tobytes())
            else:
                for x in (set_a, set_b, bands, signatures):
                    x.append(None)
        yield pa.record_batch(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = list(shingle_sets(batch.column(1)))
        total = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in sets]
        yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "set_a", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(y) < len(x):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"of_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(_verified, "a long, b long")


def _agreeing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose signatures agree in ``least`` places; a group with more than two a row is named
    instead."""
    for rows, group in whole_groups(batches, _GROUP, 4096):
        own, comp, block, i, j, key = (rows.column(x).to_numpy() for x in ("doc_id", "component", "block", "i", "j", "key"))
        sketch = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        left, right, shift, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, np.arange(len(own))
        while True:
            shift += 1
            at = at[at + shift < len(own)]
            at = at[group[at] == group[at + shift]]
            if not len(at):
                break
            x = at[(comp[at] != comp[at + shift]) & ((i[at] == j[at]) | (block[at] != block[at + shift]))]
            for lo in range(0, len(x), 8192):
                some = x[lo : lo + 8192]
                hit = some[(sketch[some] == sketch[some + shift]).sum(axis=1) >= least]
                left.append(hit), right.append(hit + shift)
        left, right = np.concatenate(left), np.concatenate(right)
        dense = np.bincount(group[left], minlength=group[-1] + 1) > 2 * np.bincount(group)
        few = ~dense[group[left]]
        left, right, first = left[few], right[few], np.searchsorted(group, np.flatnonzero(dense))
        none = pa.nulls
        yield pa.record_batch([pa.array(own[left]), pa.array(own[right]), none(len(left), pa.int64()), none(len(left), pa.int32()), none(len(left), pa.int32())], ["a", "b", "key", "i", "j"])
        yield pa.record_batch([none(len(first), pa.int64()), none(len(first), pa.int64()), pa.array(key[first]), pa.array(i[first]), pa.array(j[first])], ["a", "b", "key", "i", "j"])


def _dense_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links across components within whole groups, as a forest that joins the same rows."""
    for rows, group in whole_groups(batches, _GROUP):
        for lo, hi in group_bounds(group):
            part = rows.slice(lo, hi - lo)
            own, comp, block = (part.column(x).to_numpy() for x in ("doc_id", "component", "block"))
            sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
            both, size = _intersections(sets), np.array([len(x) for x in sets])
            link = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
            link &= comp[:, None] != comp[None, :]
            if part.column("i")[0] != part.column("j")[0]:
                link &= block[:, None] != block[None, :]
            label = forest(link)
            moved = np.flatnonzero(label != np.arange(len(own)))
            yield pa.record_batch([pa.array(own[label[moved]]), pa.array(own[moved])], ["a", "b"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(number, kind="stable")
    order = order[np.searchsorted(number[order], 0) :]
    number, owner = number[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int((count > 1).sum()), 4096):
        here = slice(*np.searchsorted(number, [lo, lo + 4096]))
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[here], number[here] - lo] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _links_across(buckets: DataFrame, labels: DataFrame, sketches: DataFrame, sets: DataFrame, least_agreeing: int) -> DataFrame:
    """Links between different components within a bucket. Rows of a bucket's largest component meet only the others.

    The others are cut into blocks and so is the largest component; every pair of blocks is a group of its own, so that
    no group grows with the bucket. Signatures rule out most pairs; of what is left, a group with few pairs gives them
    for verification, and one with many is verified where its rows stand, so that pairs never outnumber rows by much.
    """
    rows = buckets.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("key", F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many"))
    rows = join_by_key(rows, open_, ["key"], ["doc_id"])
    is_main = F.col("component") == F.col("main")
    rows = rows.withColumn("block", F.when(is_main, F.col("few") + F.pmod(F.xxhash64("doc_id"), "many")).otherwise(F.pmod(F.xxhash64("doc_id"), "few")).cast("int"))
    meets = F.when(is_main, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1))
    rows = rows.withColumn("other", F.explode(meets)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = stored(rows.select("key", "i", "j", "block", "doc_id", "component"), "minhash-open")

    together = lambda x: x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block")
    found = together(rows.join(sketches.select("doc_id", "signature"), "doc_id")).select("key", "i", "j", "block", "doc_id", "component", "signature")
    found = stored(found.mapInArrow(lambda batches: _agreeing(batches, least_agreeing), "a long, b long, key long, i int, j int"), "minhash-agreeing")
    pairs = found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    dense = rows.join(found.filter("a is null").select("key", "i", "j"), ["key", "i", "j"], "left_semi")
    dense = together(dense.join(sets, "doc_id")).select("key", "i", "j", "block", "doc_id", "component", "shingles")
    links = stored(_verify(pairs, sets).unionAll(dense.mapInArrow(_dense_links, "a long, b long")), "minhash-links")
    drop(rows, found)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_agreeing: int = LEAST_AGREEING) -> DataFrame:
    """Groups of near-duplicate documents.

    A document's set holds the distinct 5-word shingles of its whole text (A-Z lower-cased, words split at ASCII white
    space), or all its words as one shingle where there are fewer; null, empty and blank texts have an empty set and link
    with nothing. Documents link at 100 * intersection >= 75 * union of the full sets. Returns one row per input row:
    ``doc_id, n_shingles, component_id`` (smallest id reachable by links), ``kept`` (doc_id = component_id). Repeated
    ids keep a row each, and one with several texts links with whatever any of them links with; a row with a null id is
    kept out of groups, but takes the component of a text that it copies. Other columns are not read; an empty table
    gives an empty one.

    Equal sets become one class first, so copies never meet each other. Classes link to the smallest of each band
    bucket; only buckets that then still hold several components compare further pairs, block by block. Of these, pairs
    whose signatures agree in fewer than ``least_agreeing`` places are left out unless their group is dense; 0 verifies
    every pair that shares a bucket.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(docs.mapInArrow(_sketch, _SKETCH).withColumn(_ROW, F.monotonically_increasing_id()), "minhash-sketches")
    classes = sketches.filter("set_a is not null and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
    classes = stored(classes.agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "minhash-classes")
    rows = classes.select("doc_id", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    buckets = stored(join_by_key(rows, heads, ["key"], ["doc_id"]).select("doc_id", "key", "head"), "minhash-buckets")
    stars = stored(buckets.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "minhash-stars")

    members = buckets.select("doc_id").distinct()
    sets = stored(docs.join(members, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set_a long, shingles binary").dropDuplicates(["doc_id", "set_a"]), "minhash-sets", compression="none")
    links = stored(_verify(stars, sets), "minhash-links")
    more = _links_across(buckets, connected_components(links), classes, sets, least_agreeing)
    labels = connected_components(links.unionAll(more))
    drop(buckets, stars, sets, links, more)
    named = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    out = join_by_key(sketches.select("doc_id", "n_shingles", "set_a", "set_b", _ROW), named, ["set_a", "set_b", "n_shingles"], [_ROW], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with all its columns: that with the smallest id, of equal ids that with the smallest
    hash of its text, a null id after all others.

    Rows are told apart by a number of their own, so that different texts under one id are groups of their own, and
    copies without an id are copies like others. Columns of any name stay as they are.
    """
    row = _ROW
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-rows")
    found = near_duplicates(rows, row).select(F.col("doc_id").alias(row), F.col("component_id").alias("_component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row).alias("row")))
    thin = rows.select(row, "doc_id", "text").join(found, row)
    kept = thin.groupBy("_component").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
