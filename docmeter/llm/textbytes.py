"""Vectorised views of text columns: word bounds and 64-bit hashes straight from Arrow's byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on (a longer text is one step of its own).
STEP_BYTES = (1 << 19) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE_VALUES = _BYTE_VALUES.copy()
_LOWER_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 * STEP_BYTES:  # one very long text: made for this step alone
        return tuple(_running_power(b, n) for b in (_BASE, _BASE_INVERSE))
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[:] = [_running_power(b, size) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _running_power(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class SpanHasher:
    """Hashes of any byte spans of ``data`` in constant time each, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, fold_ascii_case: bool = False, values: np.ndarray | None = None):
        """``values``: a random odd number for each symbol of ``data``, if it holds others than bytes."""
        self._power, self._inverse = _power_tables(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        value = ((_LOWER_BYTE_VALUES if fold_ascii_case else _BYTE_VALUES) if values is None else values)[data]
        value *= self._power[: len(data)]
        np.cumsum(value, out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of fewer, so that what a step makes of them stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on, and others share its machine


def steps(bounds: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes together, or of one longer text."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(separator: np.ndarray, bounds: np.ndarray, also_start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without separators, and per text the index of its first run (n + 1 values).

    ``bounds`` cut the bytes into texts; a run never crosses one. ``also_start`` marks further places where a run begins.
    """
    n = len(separator)
    fresh = np.empty(n + 1, bool)
    fresh[0] = fresh[n] = True
    fresh[1:n] = separator[:-1]
    fresh[bounds] = True
    if also_start is not None:
        fresh[:n] |= also_start
    inside = ~separator
    start = np.flatnonzero(inside & fresh[:n])
    last = fresh[1:].copy()
    last[: n - 1] |= separator[1:] if n else False
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(start, bounds)


def word_sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive values; position i covers i to i + length - 1."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(length), np.uint64)
    for k in range(length):
        total *= _BASE
        total += hashes[k : k + n]
    return mixed(total)


class HashIndex:
    """Open-addressing map from 64-bit keys to non-negative ints, probed and filled with whole arrays."""

    def __init__(self, capacity: int):
        self._bits = max(10, (capacity * 4 // 3).bit_length())
        self._key = np.zeros(1 << self._bits, np.uint64)
        self._value = np.full(1 << self._bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot, mask = self._slot(keys), len(self._key) - 1
        out = self._value[slot]
        open_ = np.flatnonzero((self._key[slot] != keys) & (out >= 0))
        out[open_] = -1
        while len(open_):
            at = (slot[open_] + 1) & mask
            slot[open_] = at
            value, hit = self._value[at], self._key[at] == keys[open_]
            hit &= value >= 0
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the map yet."""
        slot, mask = self._slot(keys), len(self._key) - 1
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self._value[at] < 0
            take, place = left[free], at[free]
            self._value[place] = values[take]  # of several for one place the last stays
            self._key[place] = keys[take]
            won = np.zeros(len(left), bool)
            won[free] = (self._value[place] == values[take]) & (self._key[place] == keys[take])
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask
