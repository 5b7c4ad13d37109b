"""Alignment of the tokens that two tokenizers make of the same texts, and how often ids meet corpus-wide.

Texts are tokenised whole. Where both tokenizers end a token and both next tokens begin with a space, a text is cut into
windows; equal windows (the same ids on both sides) are aligned once for each worker and remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.grouped import group_bounds, whole_groups
from docmeter.llm.textbytes import HashIndex, SpanHasher, mixed, sliced, steps, text_buffers
from docmeter.llm.workspace import stored

#: Bytes of text whose documents share one dictionary of id pairs, and that are tokenised at a time.
CHUNK_BYTES, STEP = 1 << 24, (1 << 19) - 1
#: Windows that a worker remembers before it starts anew with its next chunk.
REMEMBERED = 400_000
#: Texts of more characters are tokenised in parts of about this many, cut where both tokenizers cut anyway.
PART_CHARS = 1 << 18
#: Links of a group that are written out one by one; larger groups are counted by distinct ids.
WRITTEN_OUT = 1 << 12

# The pattern by which byte-level vocabularies of this kind cut texts, and the mark that stands for a space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARK = "▁"
#: Both tokenizers cut before a space between these: the first one's pattern, and the second one's pieces hold no inner mark.
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def byte_symbols() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones stand for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Tokens:
    """A tokenizer: ids of texts, the bytes of each id, and whether texts may be cut at ``_CUT``."""

    encode: Callable[[list[str]], list[list[int]]]
    spelled: list[bytes]
    may_cut: bool


@cache
def first_tokens(path: str) -> Tokens:
    """Byte-level BPE in a tokenizers file; special tokens' strings in texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cutter = file["model"], file.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or file.get("normalizer"):
        raise ValueError("only byte-level BPE without normalisation and without a space of its own")
    special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    symbols, vocabulary = byte_symbols(), {p: i for p, i in model["vocab"].items() if p not in special}
    spelled = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
    for piece, i in vocabulary.items():
        spelled[i] = bytes(symbols[c] for c in piece)
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    plain = cutter.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges") and {len(spelled[i]) for i in range(256)} == {1}
    if plain and [vocabulary.get(p) for p in merged] == list(range(256, 256 + len(merged))) and len(vocabulary) == 256 + len(merged):
        import tiktoken  # ids in order of merging are ranks

        ranks = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks={spelled[i]: i for i in vocabulary.values()}, special_tokens={})
        return Tokens(lambda texts: [ranks.encode_ordinary(t) for t in texts], spelled, True)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Tokens(lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], spelled, False)


@cache
def second_tokens(path: str) -> Tokens:
    """A SentencePiece model, which puts a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
    return Tokens(lambda texts: model.encode(texts, num_threads=1), spelled, not any(_MARK in p[1:] and p.strip(_MARK) for p in pieces))


def _parts(text: str) -> list[str]:
    """A long text in parts that begin where both tokenizers cut, without the space before them."""
    out, lo = [], 0
    while len(text) - lo > PART_CHARS and (cut := _CUT.search(text, lo + PART_CHARS)):
        out.append(text[lo : cut.start()])
        lo = cut.end()
    return [*out, text[lo:]]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.array, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.array):
            self.array = np.concatenate([self.array, np.zeros_like(self.array)])
        self.array[self.used : self.used + len(values)] = values
        self.used += len(values)


class _Numbers:
    """Numbers of 64-bit keys in order of appearance."""

    def __init__(self) -> None:
        self.keys, self._room = _Grown(np.uint64), 1 << 18
        self._index = HashIndex(self._room)

    def __len__(self) -> int:
        return self.keys.used

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self._index.find(keys)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Distinct keys that have no number yet."""
        new = np.arange(len(self), len(self) + len(keys), dtype=np.int32)
        self.keys.add(keys)
        if len(self) > self._room:
            self._room = 2 * len(self)
            self._index, keys = HashIndex(self._room), self.keys.array[: len(self)]
            self._index.add(keys, np.arange(len(self), dtype=np.int32))
        else:
            self._index.add(keys, new)
        return new


class Aligner:
    """Alignments of texts; windows and id pairs are numbered and remembered."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = (first_tokens(path_a), second_tokens(path_b))
        self._size = [np.array([len(x) for x in s.spelled], np.int64) for s in self.sides]
        self._spaced = [np.array([x[:1] == b" " for x in s.spelled]) for s in self.sides]
        draw = np.random.default_rng(11)
        self._values = [draw.integers(1, 1 << 63, len(x), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for x in self._size]
        self.forget()

    def forget(self) -> None:
        self._windows, self.pairs = _Numbers(), _Numbers()
        self._start, self._pair, self._times = _Grown(np.int64), _Grown(np.int32), _Grown(np.int64)
        self._start.add(np.zeros(1, np.int64))
        self._groups, self._links, self._text = _Grown(np.int64), _Grown(np.int64), []

    @property
    def full(self) -> bool:
        return len(self._windows) > REMEMBERED

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space and text under the first tokenizer, and of the text under the second one."""
        cut = [_parts(t) if len(t) > PART_CHARS and all(s.may_cut for s in self.sides) else [t] for t in texts]
        a, b = iter(self.sides[0].encode([" " + p for parts in cut for p in parts])), iter(self.sides[1].encode([p for parts in cut for p in parts]))
        join = lambda of, n: next(of) if n == 1 else [i for _ in range(n) for i in next(of)]
        return [join(a, len(p)) for p in cut], [join(b, len(p)) for p in cut]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts both tokenizers spell, their numbers of tokens, all their windows, and where each text's begin."""
        ids = self.encode(texts)
        good = [k for k, t in enumerate(texts) if t and all(b"".join(map(s.spelled.__getitem__, x[k])) == b" " + t.encode() for s, x in zip(self.sides, ids, strict=True))]
        counts = [np.array([len(x[k]) for k in good], np.int64) for x in ids]
        if not good:
            return np.array(good, np.int64), *counts, np.zeros(0, np.int64), np.zeros(1, np.int64)
        a, b = (np.concatenate([np.array(x[k], np.int64) for k in good]) for x in ids)
        end_a, end_b = np.cumsum(self._size[0][a]), np.cumsum(self._size[1][b])
        ends = np.zeros(end_a[-1] + 1, bool)
        ends[end_b] = True
        at_a = np.flatnonzero(ends[end_a])
        ends[end_b] = False
        ends[end_a] = True
        at_b = np.flatnonzero(ends[end_b])  # the same places: group g ends with tokens at_a[g] and at_b[g]
        last = np.zeros(len(a), bool)
        last[np.cumsum(counts[0]) - 1] = True
        anchor = self._spaced[0][a[np.minimum(at_a + 1, len(a) - 1)]] & self._spaced[1][b[np.minimum(at_b + 1, len(b) - 1)]] | last[at_a]
        cut = np.flatnonzero(anchor)
        before = np.append(-1, cut[:-1])
        bounds = [(np.append(-1, at)[before + 1] + 1, at[cut] + 1) for at in (at_a, at_b)]
        keys = [SpanHasher(x, values=v)(*w) for x, v, w in zip((a, b), self._values, bounds, strict=True)]
        key = mixed(keys[0] + mixed(keys[1] ^ np.uint64(0x5DEECE66D)))
        window = self._windows.find(key)
        miss = np.flatnonzero(window < 0)
        if len(miss):
            new, first = np.unique(key[miss], return_index=True)
            self._windows.add(new)
            self._learn(a, b, at_a, at_b, before[miss[first]] + 1, cut[miss[first]] + 1)
            window = self._windows.find(key)
        return np.array(good, np.int64), *counts, window, np.searchsorted(cut, np.append(-1, np.flatnonzero(last[at_a])), "right")

    def _learn(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Align new windows, which are the groups lo to hi: every token of a group links with all of the other side."""
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        group = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(owner))
        (a0, a1), (b0, b1) = ((np.append(-1, at)[group] + 1, at[group] + 1) for at in (at_a, at_b))
        links = (a1 - a0) * (b1 - b0)
        small = np.flatnonzero(links <= WRITTEN_OUT)
        row = np.repeat(small, links[small])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        wide = (b1 - b0)[row]
        found = [(owner[row], a[a0[row] + nth // wide] << 32 | b[b0[row] + nth % wide], np.ones(len(row), np.int64))]
        for g in np.flatnonzero(links > WRITTEN_OUT).tolist():
            (ia, na), (ib, nb) = np.unique(a[a0[g] : a1[g]], return_counts=True), np.unique(b[b0[g] : b1[g]], return_counts=True)
            for k in range(len(ia)):
                found.append((np.full(len(ib), owner[g]), ia[k] << 32 | ib, na[k] * nb))
        owner_of, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        key = mixed(pair.view(np.uint64))
        number = self.pairs.find(key)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            self.pairs.add(np.unique(key[miss]))
            number = self.pairs.find(key)
        owner_of, number, times = _added_up(owner_of, number, times)
        self._pair.add(number)
        self._times.add(times)
        self._start.add(self._start.array[self._start.used - 1] + np.cumsum(np.bincount(owner_of, minlength=len(lo))))
        self._groups.add(size)
        self._links.add(np.bincount(owner, links, len(lo)).astype(np.int64))
        ids_a, ids_b, bounds = a.tolist(), b.tolist(), [x.tolist() for x in (a0, a1, b0, b1)]
        each = [f"{','.join(map(str, ids_a[p:q]))}|{','.join(map(str, ids_b[r:s]))}" for p, q, r, s in zip(*bounds, strict=True)]
        end = np.cumsum(size).tolist()
        self._text += [";".join(each[p:q]).encode() for p, q in zip([0, *end[:-1]], end, strict=True)]

    def totals(self, windows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        return tuple(np.diff(np.append(0, np.cumsum(x.array[windows]))[first]) for x in (self._groups, self._links))

    def groups(self, windows: np.ndarray) -> bytes:
        return b";".join(map(self._text.__getitem__, windows.tolist()))

    def links(self, windows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, number of the id pair, and how often it is linked there, by text and pair."""
        text, window, n = _added_up(np.repeat(np.arange(len(first) - 1), np.diff(first)), windows, np.ones(len(windows), np.int64))
        start = self._start.array[window]
        size = self._start.array[window + 1] - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return _added_up(np.repeat(text, size), self._pair.array[at], self._times.array[at] * np.repeat(n, size))

    def spelled_pairs(self, numbers: np.ndarray) -> np.ndarray:
        """First id times 2^32 plus second id of numbered pairs."""
        return _unmixed(self.pairs.keys.array[numbers]).view(np.int64)


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    undo = lambda v, k: v ^ (v >> np.uint64(k)) ^ (v >> np.uint64(2 * k)) if 3 * k >= 64 else v ^ (v >> np.uint64(k)) ^ (v >> np.uint64(2 * k)) ^ (v >> np.uint64(3 * k))
    x = undo(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = undo(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return undo(x, 30)


def _added_up(owner: np.ndarray, number: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by owner and number, in this order."""
    key = owner.astype(np.int64) << 32 | number
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first] >> 32, (key[first] & 0xFFFFFFFF).astype(np.int64), np.add.reduceat(times[order], first) if len(first) else times[:0]


# ------------------------------------------------------------------------------------------------ tasks

_PART = "chunk long, nth int, pair long, n_docs long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, at array<int>, times array<long>"
_NAMES = [x.split(" ")[0] for x in _PART.split(", ")]


class _Chunk:
    """Documents that share a dictionary of pairs, until their rows are written."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.doc_id, self.counts, self.sha, self.groups = [], [], [], []
        self.pairs, self.times, self.sizes = [], [], []

    def rows(self, aligner: Aligner) -> Iterator[pa.RecordBatch]:
        pairs, times = np.concatenate([*self.pairs, np.zeros(0, np.int64)]), np.concatenate([*self.times, np.zeros(0, np.int64)])
        used, n_docs = np.unique(pairs, return_counts=True)
        spelled, at = aligner.spelled_pairs(used), np.searchsorted(used, pairs).astype(np.int32)
        for lo in range(0, len(used), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            yield self._batch({"nth": np.arange(len(used), dtype=np.int32)[some], "pair": spelled[some], "n_docs": n_docs[some]})
        doc_id, counts, size = np.concatenate(self.doc_id), np.concatenate(self.counts), np.concatenate(self.sizes)
        end = np.append(0, np.cumsum(size))
        for lo in range(0, len(size), 256):
            hi = min(lo + 256, len(size))
            cut = pa.array((end[lo : hi + 1] - end[lo]).astype(np.int32))
            lists = {k: pa.ListArray.from_arrays(cut, pa.array(x[end[lo] : end[hi]])) for k, x in (("at", at), ("times", times))}
            valid = doc_id[lo:hi]
            ids = pa.array(valid[:, 0], mask=valid[:, 1] > 0)
            yield self._batch({"doc_id": ids, "groups_sha256": self.sha[lo:hi], "groups": self.groups[lo:hi]} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts[lo:hi].T, strict=True)) | lists)

    def _batch(self, columns: dict) -> pa.RecordBatch:
        kinds = dict(zip(_NAMES, (pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True))
        n = len(next(iter(columns.values())))
        columns = {"chunk": np.full(n, self.number)} | columns
        return pa.record_batch([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], kinds[k]) if k in columns else pa.nulls(n, kinds[k]) for k in _NAMES], _NAMES)


_worker: dict[tuple[str, str], Aligner] = {}


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], with_groups: bool) -> Iterator[pa.RecordBatch]:
    if paths not in _worker:
        _worker.clear()  # one memory of windows at a time
        _worker[paths] = Aligner(*paths)
    aligner, chunk = _worker[paths], _Chunk(TaskContext.get().partitionId() << 32)
    for batch in sliced(batches):
        data, bounds = text_buffers(batch.column(1))
        for lo, hi in steps(bounds, STEP):
            _add(chunk, aligner, batch.column(0).slice(lo, hi - lo), [data[p:q].tobytes().decode() for p, q in zip(bounds[lo:hi], bounds[lo + 1 : hi + 1], strict=True)], with_groups)
            chunk.bytes += int(bounds[hi] - bounds[lo])
            if chunk.bytes >= CHUNK_BYTES:
                yield from chunk.rows(aligner)
                chunk = _Chunk(chunk.number + 1)
                if aligner.full:
                    aligner.forget()
    if chunk.doc_id:
        yield from chunk.rows(aligner)


def _add(chunk: _Chunk, aligner: Aligner, ids: pa.Array, texts: list[str], with_groups: bool) -> None:
    good, n_a, n_b, windows, first = aligner(texts)
    counts, size = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), np.int64)
    sha, groups = [""] * len(texts), [""] * len(texts)
    if len(good):
        counts[good] = np.stack([n_a, n_b, *aligner.totals(windows, first)], axis=1)
        text, pair, times = aligner.links(windows, first)
        size[good] = np.bincount(text, minlength=len(good))
        chunk.pairs.append(pair)
        chunk.times.append(times)
        for k, p, q in zip(good.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            spelled = aligner.groups(windows[p:q])
            sha[k] = hashlib.sha256(spelled).hexdigest()
            groups[k] = spelled.decode() if with_groups else ""
    chunk.doc_id.append(np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)], axis=1).astype(np.int64))
    chunk.counts.append(counts)
    chunk.sizes.append(size)
    chunk.sha += sha
    chunk.groups += groups if with_groups else [None] * len(texts)


_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the sums over their links of the counts that their chunk's dictionary now has."""
    for rows, group in whole_groups(batches, ["chunk"]):
        for lo, hi in group_bounds(group):
            one = rows.slice(lo, hi - lo).combine_chunks()
            is_doc = one.column("is_doc").to_numpy()
            n = int(np.searchsorted(is_doc, True))  # the dictionary stands first
            nth, told = one.column("nth").slice(0, n).to_numpy(), np.zeros((2, max(n, 1)), np.int64)
            told[:, nth] = one.column("n_docs").slice(0, n).to_numpy(), one.column("best").slice(0, n).to_numpy()
            docs = one.slice(n).combine_chunks()
            at, times = (docs.column(k).combine_chunks() for k in ("at", "times"))
            end = np.append(0, np.cumsum(at.value_lengths().to_numpy()))
            at, times = at.flatten().to_numpy(), times.flatten().to_numpy()
            sums = [np.diff(np.append(0, np.cumsum(times * x[at]))[end]) for x in told]
            columns = {"n_best": pa.array(sums[1]), "count_sum": pa.array(sums[0])}
            names = [x.split(" ")[0] for x in _DOCUMENT.split(", ")]
            yield from pa.table([columns[k] if k in columns else docs.column(k) for k in names], names).to_batches()


# ------------------------------------------------------------------------------------------------ the operator


@dataclass
class Alignment:
    """``documents``: a row for each text. ``pairs``: ``a, b, n_docs`` (documents that hold the pair linked), ``best``."""

    documents: DataFrame
    pairs: DataFrame


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> Alignment:
    """Alignment of the tokens of space and text under a byte-level BPE file (A) with a SentencePiece model's (B).

    Byte places where tokens of both end cut a text into groups; each A token of a group links with each B token of it.
    ``documents`` has one row per input row: ``doc_id, n_a, n_b, n_groups, n_links``, ``n_best`` (links whose pair's count
    is the highest of its A id in the corpus, ties included), ``count_sum`` (counts over links), ``groups_sha256`` of
    ``a1,a2|b1;a3|b2`` and, ``with_groups``, that text itself. A pair's count is the number of documents that hold it.

    Null and empty texts, and texts that the tokens of a side don't spell (the mark U+2581 in a text), have no tokens: zeros
    and an empty digest. Repeated and null ids keep a row each and count as documents of their own. Very long texts are
    tokenised in parts that begin where both tokenizers cut anyway; a text without such a place, whole. Other columns are
    not read; an empty table gives empty ones.

    Texts are read once. Documents of CHUNK_BYTES of text share a dictionary of their id pairs, so that counts are added up
    from one row for each chunk and pair, and come back to the chunk likewise; a document's links travel as numbers of that
    dictionary. What a task holds is bounded by a chunk; windows are remembered under 64-bit hashes of their ids.
    """
    paths = (path_a or default_paths()[0], path_b or default_paths()[1])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = stored(rows.mapInArrow(lambda batches: _aligned(batches, paths, with_groups), _PART), "alignment-parts")
    entries = parts.filter("nth is not null").select("chunk", "nth", "pair", "n_docs")
    counts = entries.groupBy("pair").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    counts = counts.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    counts = stored(counts, "alignment-pairs")
    known = entries.select("chunk", "nth", "pair").join(counts, "pair")
    of_docs = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "at", "times"]
    known = known.select("chunk", F.lit(False).alias("is_doc"), "nth", "n_docs", F.col("best").cast("long").alias("best"), *(F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in of_docs))
    texts = parts.filter("nth is null").select("chunk", F.lit(True).alias("is_doc"), *(F.lit(None).cast(k).alias(c) for c, k in (("nth", "int"), ("n_docs", "long"), ("best", "long"))), *of_docs)
    together = known.unionAll(texts).repartition("chunk").sortWithinPartitions("chunk", "is_doc")
    documents = together.mapInArrow(_judged, _DOCUMENT)
    pairs = counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n_docs", "best")
    return Alignment(documents if with_groups else documents.drop("groups"), pairs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents
