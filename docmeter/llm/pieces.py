"""SentencePiece encoding and decoding of whole texts by a batched Viterbi pass in numpy.

The model file is a BPE one, whose right result is not the segmentation with the best sum of scores but the one that
merging in order of score leaves. It is found by dynamic programming all the same: a segmentation is the merged one exactly
if each piece is what merging makes of its own characters and each two neighbours are what merging makes of both. So
the best path to each place needs its last piece only; a step scores a piece by its length if it may follow the best
path's last piece and by nothing otherwise, and the maximum (only one piece scores) is the backpointer.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.textbytes import HashIndex, SpanHasher, mixed, sliced, spans, steps, text_buffers

#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 2_000_000
#: Bytes of text whose new words are segmented together.
TOGETHER = 1 << 21
_MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1 << 40)
_SIEVE = 22
#: Characters that advance together at most.
_CELLS = 1 << 18


@dataclass
class PieceModel:
    """Arrays over piece numbers, and one more number for any character that is no piece."""

    size: int
    keys: np.ndarray  # sorted hashes of pieces that merging can leave, and their numbers
    key_piece: np.ndarray
    longest: int
    rank: np.ndarray  # order of merging, -1 for single characters
    left: np.ndarray  # the two pieces that the last merge of a piece joins
    right: np.ndarray
    pairs: np.ndarray  # sorted codes of two pieces that together are one, and that one's rank
    pair_rank: np.ndarray
    key_sieve: np.ndarray
    pair_sieve: np.ndarray
    cuts: np.ndarray  # whether no piece holds one ASCII character before another
    byte_ids: np.ndarray
    mark: int  # the piece of a single mark
    runs: dict[int, int]  # pieces of marks only, by length
    spelled: list[bytes]


def _merged(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging leaves of a text, and the last two pieces that it joined."""
    parts, last = list(text), None
    while True:
        best = min(((rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(_NEVER, 0))
        if best[0] == _NEVER:
            return parts, last
        i = best[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _hash_columns(codes: np.ndarray) -> np.ndarray:
    """Running hash of the prefixes of words that stand in columns, 0 for the empty one."""
    out = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    for i, value in enumerate(mixed(codes.astype(np.uint64) + np.uint64(1))):
        out[i + 1] = out[i] * _BASE + value
    return out


def _sieve(keys: np.ndarray) -> np.ndarray:
    """Which of ``_SIEVE`` leading-bit patterns some key has: most lookups of absent keys end here."""
    out = np.zeros(1 << _SIEVE, bool)
    out[keys >> np.uint64(64 - _SIEVE)] = True
    return out


def _in_sieve(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return sieve[(keys >> np.uint64(64 - _SIEVE)).view(np.int64)]


@cache
def load_model(path: str) -> PieceModel:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != proto.trainer_spec.BPE or proto.normalizer_spec.name != "identity" or not proto.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback and without normalisation")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
    runs = {len(p): i for p, (i, _) in pieces.items() if not p.strip(_MARK)}
    words = {p: x for p, x in pieces.items() if len(p) == 1 or p.strip(_MARK)}
    if any(_MARK in p[1:] or "\n" in p for p in words):
        raise ValueError("pieces that hold a mark or a line feed beyond their start")
    order = {p: r for r, p in enumerate(sorted((p for p in words if len(p) > 1), key=lambda p: -words[p][1]))}
    size = len(proto.pieces)
    rank, left, right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
    kept, pairs = [], {}
    for p, (i, _) in words.items():
        if len(p) == 1:
            kept.append(p)
            continue
        rank[i] = order[p]
        parts, last = _merged(p, order)
        if len(parts) == 1:
            kept.append(p)
            left[i], right[i] = words[last[0]][0], words[last[1]][0]
        for cut in range(1, len(p)):
            if p[:cut] in words and p[cut:] in words:
                pairs[words[p[:cut]][0] * (size + 1) + words[p[cut:]][0]] = order[p]
    keys, numbers = np.zeros(len(kept), np.uint64), np.array([words[p][0] for p in kept])
    by_length = defaultdict(list)
    for k, p in enumerate(kept):
        by_length[len(p)].append(k)
    for n, ks in by_length.items():
        keys[ks] = _hash_columns(np.array([[ord(c) for c in kept[k]] for k in ks], np.uint32).T)[n]
    by_key, codes = np.argsort(keys), np.array(sorted(pairs), np.int64)
    cuts = np.zeros((256, 256), bool)
    cuts[:128, :128] = True
    for p in words:
        for x, y in zip(p, p[1:], strict=False):
            if max(x, y) < "\x80":
                cuts[ord(x), ord(y)] = False
    byte_ids = np.array([i for i, p in enumerate(proto.pieces) if p.type == p.BYTE], np.int64)
    spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else b"" if p.type == p.CONTROL else " ⁇ ".encode() if p.type == p.UNKNOWN else p.piece.replace(_MARK, " ").encode() for p in proto.pieces]
    return PieceModel(size, keys[by_key], numbers[by_key], max(by_length), rank, left, right, codes, np.array([pairs[c] for c in codes.tolist()], np.int64), _sieve(keys), _sieve(mixed(codes.view(np.uint64))), cuts, byte_ids, words[_MARK][0], {1: words[_MARK][0]} | runs, spelled)


def _may_follow(m: PieceModel, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether merging leaves x and y, standing side by side, apart.

    Going back in time, the piece that was made later is undone; what then stood at the border would have been joined if
    its joint piece comes before whatever made the border's pieces part of larger ones (the left one first on a tie).
    """
    ok, open_ = np.ones(len(x), bool), np.arange(len(x))
    x, y = x.copy(), y.copy()
    until_x, until_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
    while len(open_):
        code = x[open_] * (m.size + 1) + y[open_]
        joint, some = np.full(len(code), _NEVER), np.flatnonzero(_in_sieve(m.pair_sieve, mixed(code.view(np.uint64))))
        at = np.minimum(np.searchsorted(m.pairs, code[some]), len(m.pairs) - 1)
        joint[some] = np.where(m.pairs[at] == code[some], m.pair_rank[at], _NEVER)
        joined = (joint < until_x[open_]) & (joint <= until_y[open_]) & (joint < _NEVER)
        ok[open_[joined]] = False
        open_ = open_[~joined]
        rx, ry = m.rank[x[open_]], m.rank[y[open_]]
        more = (rx >= 0) | (ry >= 0)
        open_, rx, ry = open_[more], rx[more], ry[more]
        undo_x = rx > ry
        a, b = open_[undo_x], open_[~undo_x]
        until_x[a], until_y[b] = rx[undo_x], ry[~undo_x]
        x[a], y[b] = m.right[x[a]], m.left[y[b]]
    return ok


def viterbi(m: PieceModel, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words of one length (columns of code points), flat, and how many each word has.

    A character that is no piece comes out as ``m.size`` plus its code point. At each place exactly one last piece scores,
    so the maximum is found once any does; longer pieces are tried first.
    """
    n, rows = codes.shape
    prefix = _hash_columns(codes)
    power = np.ones(m.longest + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(m.longest, _BASE, np.uint64))
    last, step = np.full((n + 1, rows), m.size, np.int64), np.zeros((n + 1, rows), np.int64)
    for i in range(1, n + 1):
        for length in range(min(i, m.longest), 0, -1):
            key = prefix[i] - prefix[i - length] * power[length]
            some = np.flatnonzero(_in_sieve(m.key_sieve, key) & (step[i] == 0)) if length > 1 else np.flatnonzero(step[i] == 0)
            if not len(some):
                continue
            key = key[some]
            at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
            piece = np.where(m.keys[at] == key, m.key_piece[at], m.size)
            known = (piece < m.size) | (length == 1)
            some, piece = some[known], piece[known]
            fits = _may_follow(m, last[i - length, some], piece)
            last[i, some[fits]], step[i, some[fits]] = piece[fits], length
    found, left, place = np.full((rows, n), -1, np.int64), np.arange(rows), np.full(rows, n)
    for k in range(n - 1, -1, -1):
        at = place[left]
        piece = last[at, left]
        found[left, k] = np.where(piece == m.size, m.size + codes[at - 1, left], piece)
        place[left] -= step[at, left]
        left = left[place[left] > 0]
        if not len(left):
            break
    return found[found >= 0], (found >= 0).sum(axis=1)


def encode_spans(m: PieceModel, codes: np.ndarray, start: np.ndarray, size: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that are spans of an array of code points, flat in the order given, and how many each has.

    Words of one length advance together; ``marked`` ones have a mark put before them.
    """
    length = size + marked
    order = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(length[order]) > 0)).tolist() + [len(order)]
    flats, counts, taken = [], [], []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        n = int(length[order[lo]]) if lo < hi else 0
        for a in range(lo, hi if n else lo, max(1, _CELLS // max(n, 1))):
            ks = order[a : min(hi, a + max(1, _CELLS // n))]
            at = start[ks] - marked[ks] + np.arange(n)[:, None]
            block = codes[np.maximum(at, 0)]
            block[0, marked[ks]] = ord(_MARK)
            flat, count = viterbi(m, block)
            if (flat >= m.size).any():  # bytes stand for characters that are no pieces
                rare = np.flatnonzero(flat >= m.size)
                kinds, kind = np.unique(flat[rare] - m.size, return_inverse=True)
                spelled = [m.byte_ids[list(chr(i).encode("utf-8", "replace"))] for i in kinds.tolist()]
                size_of = np.ones(len(flat), np.int64)
                size_of[rare] = np.array([len(x) for x in spelled])[kind]
                wide, is_byte = np.repeat(flat, size_of), np.repeat(flat >= m.size, size_of)
                wide[is_byte] = np.concatenate([spelled[k] for k in kind.tolist()])
                count = np.add.reduceat(size_of, np.cumsum(count) - count)
                flat = wide
            flats.append(flat.astype(np.int32))
            counts.append(count)
            taken.append(ks)
    total = np.zeros(len(start), np.int64)
    if not taken:
        return np.zeros(0, np.int32), total
    taken, flat, count = np.concatenate(taken), np.concatenate(flats), np.concatenate(counts)
    total[taken] = count
    to = np.repeat((np.cumsum(total) - total)[taken] - (np.cumsum(count) - count), count) + np.arange(len(flat))
    out = np.empty(len(flat), np.int32)
    out[to] = flat
    return out, total


def encode_words(m: PieceModel, words: list[str]) -> list[np.ndarray]:
    """Ids of words that hold no mark but at their start."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    flat, count = encode_spans(m, codes, np.cumsum(size) - size, size, np.zeros(len(words), bool))
    return np.split(flat, np.cumsum(count)[:-1]) if words else []


@dataclass
class _Words:
    """Words of some texts as byte spans, their keys, and the texts that go the slow way."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    marked: np.ndarray
    gap: np.ndarray
    key: np.ndarray
    odd: np.ndarray

    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """All code points, and the number of the one that begins at each byte."""
        place = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data & 0xC0) != 0x80, out=place[1:], dtype=np.int32)
        return np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32), place


class PieceEncoder:
    """Ids of texts; each distinct word of a worker is segmented once and remembered under a 64-bit hash."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.newline = int(model.byte_ids[10])
        self._forget()

    def _forget(self, room: int = 0) -> None:
        self._index = HashIndex(max(REMEMBERED + (1 << 18), room))
        self._flat, self._used = np.zeros(1 << 20, np.int32), 0
        self._start, self._known = np.zeros(1 << 16, np.int64), 0
        self._pending = []

    def _run(self, length: int) -> list[int]:
        """Marks that no word takes: the longest pieces first."""
        top, out = max(self.model.runs), []
        while length:
            n = min(length, top)
            out.append(self.model.runs[n])
            length -= n
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Any texts, their words segmented together: the way of texts with runs of spaces or with the mark itself."""
        cuts = [list(_split_runs(t.replace(_MARK, " "))) for t in texts]
        marked = [self._marked(cut) for cut in cuts]
        words = list(dict.fromkeys(w for ws in marked for w in ws))
        ids = dict(zip(words, (x.tolist() for x in encode_words(self.model, words)), strict=True))
        return [np.array(self._joined(cut, map(ids.get, ws)), np.int32) if cut else np.zeros(0, np.int32) for cut, ws in zip(cuts, marked, strict=True)]

    def _joined(self, cut: list[tuple[str, str]], words: Iterator[list[int]]) -> list[int]:
        out, spaces = [], 1
        for kind, value in cut:
            if kind == " ":
                spaces += len(value)
            elif kind == "\n":
                out += self._run(spaces) + [self.newline] * len(value)
                spaces = 0
            else:
                word = next(words)
                if spaces and word[0] == self.model.mark:
                    out += self._run(spaces) + word[1:]
                else:
                    out += self._run(max(0, spaces - 1)) + word
                spaces = 0
        return out + self._run(spaces)

    @staticmethod
    def _marked(cut: list[tuple[str, str]]) -> list[str]:
        out, before = [], " "
        for kind, value in cut:
            if kind == "w":
                out.append(_MARK + value if before == " " else value)
            before = kind
        return out

    def _learn(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._known + len(keys) + 1 > len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        self._flat[self._used : self._used + len(flat)] = flat
        self._start[self._known + 1 : self._known + 1 + len(keys)] = self._used + np.cumsum(size)
        self._index.add(keys, np.arange(self._known, self._known + len(keys), dtype=np.int32))
        self._used += len(flat)
        self._known += len(keys)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text that ``bounds`` cut from ``data``.

        Texts are cut into words, and words where no piece could span, in small steps; the new words of all of them
        advance together.
        """
        cut = [self._cut(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]) for lo, hi in steps(bounds)]
        if self._known > REMEMBERED:
            self._forget()
        new = [np.flatnonzero(self._index.find(c.key) < 0) for c in cut]
        if sum(len(x) for x in new) + self._known > REMEMBERED + (1 << 18):
            new = [np.arange(len(c.key)) for c in cut]
            self._forget(sum(len(x) for x in new))  # one very long text may hold more words than are remembered
        keys, at = np.unique(np.concatenate([c.key[x] for c, x in zip(cut, new, strict=True)] or [np.zeros(0, np.uint64)]), return_index=True)
        if len(keys):
            step = np.repeat(np.arange(len(cut)), [len(x) for x in new])[at]
            word = np.concatenate(new)[at]
            for k, c in enumerate(cut):
                some, w = keys[step == k], word[step == k]
                if len(some):
                    codes, place = c.code_points()
                    self._pending.append((some, codes, place[c.start[w]], place[c.end[w]] - place[c.start[w]], c.marked[w]))
            self._learn_pending()
        slow = iter(self.texts([c.data[c.bounds[k] : c.bounds[k + 1]].tobytes().decode() for c in cut for k in np.flatnonzero(c.odd).tolist()]))
        for c in cut:
            yield from self._ids(c, slow)

    def _learn_pending(self) -> None:
        """Segment the gathered words, all steps' words of one length together."""
        keys, codes, start, size, marked = zip(*self._pending, strict=True)
        self._pending = []
        shift = np.cumsum([0, *(len(x) for x in codes[:-1])])
        flat, count = encode_spans(self.model, np.concatenate(codes), np.concatenate([x + k for x, k in zip(start, shift.tolist(), strict=True)]), np.concatenate(size), np.concatenate(marked))
        self._learn(np.concatenate(keys), flat, count)

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> _Words:
        space, newline = data == 32, data == 10
        inner = np.zeros(len(data), bool)
        inner[1:] = self.model.cuts[data[:-1], data[1:]]
        start, end, first = spans(space | newline, bounds, inner)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[bounds] = True
        marked = fresh[start] | space[start - 1]
        gap = np.where(fresh[start], 0, start - np.append(0, end[:-1]))  # newlines before a word on the common path
        gap[~fresh[start] & space[start - 1]] -= 1
        key = mixed(SpanHasher(data)(start, end) + marked.astype(np.uint64))
        return _Words(data, bounds, start, end, first, marked, gap, key, self._odd(data, bounds, space, newline, fresh))

    def _ids(self, c: _Words, slow: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        found = self._index.find(c.key)
        size = self._start[found + 1] - self._start[found]
        each = size + c.gap
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        ids = np.full(total[-1], self.newline, np.int32)
        before = np.repeat(np.cumsum(size) - size, size)
        within = np.arange(len(before)) - before
        ids[np.repeat(total[:-1] + c.gap, size) + within] = self._flat[np.repeat(self._start[found], size) + within]
        for k, (a, b) in enumerate(zip(c.first[:-1].tolist(), c.first[1:].tolist(), strict=True)):
            yield next(slow) if c.odd[k] else ids[total[a] : total[b]]

    @staticmethod
    def _odd(data: np.ndarray, bounds: np.ndarray, space: np.ndarray, newline: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Texts with a space beside a space, a line feed or an end, with a line feed at an end, or with the mark."""
        n = len(data)
        at_end = fresh[:n] | fresh[1:]
        bad = (space | newline) & at_end
        bad[1:] |= space[1:] & (space[:-1] | newline[:-1]) & ~fresh[1:n]
        bad[1:] |= newline[1:] & space[:-1] & ~fresh[1:n]
        if n > 2:
            bad[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        return np.bincount(np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1, minlength=len(bounds) - 1)[: len(bounds) - 1] > 0


def _split_runs(text: str) -> Iterator[tuple[str, str]]:
    lo = 0
    while lo < len(text):
        kind = text[lo] if text[lo] in " \n" else "w"
        hi = lo + 1
        if kind == "w":
            cuts = [c for c in (text.find(" ", lo), text.find("\n", lo)) if c >= 0]
            hi = min(cuts, default=len(text))
        else:
            while hi < len(text) and text[hi] == kind:
                hi += 1
        yield kind, text[lo:hi]
        lo = hi


class PieceDecoder:
    """Texts of ids: bytes of all pieces in a row, without the first mark's space."""

    def __init__(self, model: PieceModel):
        size = np.array([len(x) for x in model.spelled], np.int64)
        self._flat, self._start, self._size = np.frombuffer(b"".join(model.spelled), np.uint8), np.cumsum(size) - size, size

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self._size[ids]
        out = self._flat[np.repeat(self._start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace").encode()


_worker: dict[str, PieceEncoder] = {}


def _encoded(batches: Iterator[pa.RecordBatch], path: str, model) -> Iterator[pa.RecordBatch]:
    if path not in _worker:
        _worker.clear()  # one memory of words at a time
        _worker[path] = PieceEncoder(model.value)
    encoder = _worker[path]
    for batch in sliced(batches):
        data, bounds = text_buffers(batch.column(1))
        for lo, hi in steps(bounds, TOGETHER):
            ids = list(encoder(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]))
            cut = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), rows], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    decode = PieceDecoder(model.value)
    for batch in sliced(batches):
        texts = [decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(1)]
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "text"])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text under a SentencePiece model.

    Null and empty texts have no ids; very long ones are cut into words and need no more memory than their ids and bytes; of
    equal merges the left one comes first, as in the library. One row per input row, whatever its id; other columns are not read; an empty
    table gives an empty one. Nothing is shuffled; tasks read the model's arrays, which grow with its vocabulary only.
    """
    path = path or default_path()
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _encoded(batches, path, model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text``; the text is the encoded one but for the mark U+2581, which comes back as a space."""
    model = encoded.sparkSession.sparkContext.broadcast(load_model(path or default_path()))
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, model), "doc_id long, ids array<int>, text string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in batch.column(1)]
        text = [x.as_py().encode() for x in batch.column(2)]
        values = [[len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids], [len(x) for x in text], [zlib.crc32(x) for x in text]]
        yield pa.record_batch([batch.column(0), *(pa.array(v, pa.int64()) for v in values)], ["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "decoded_crc32"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, and of the texts that they decode to."""
    model = spark.sparkContext.broadcast(load_model(default_path()))
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.mapInArrow(lambda batches: _digested(_decoded(batches, model)), "doc_id long, n_ids long, ids_crc32 long, decoded_bytes long, decoded_crc32 long")
