"""Whole groups out of Arrow batches whose rows are sorted by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some whole groups at a time, at least ``least_rows`` rows together but for the last, and each row's group number."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]) if rest is not None else table
        if rest.num_rows < least_rows:
            continue
        group = _numbers(rest, keys)
        whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
        if whole:
            yield rest.slice(0, whole), group[:whole]
            rest = rest.slice(whole).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, _numbers(rest, keys)


def _numbers(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        value = rows.column(k).to_numpy()
        new |= value[1:] != value[:-1]
    return np.cumsum(np.append(0, new))[: rows.num_rows]


def group_bounds(group: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
    return list(zip(cut, cut[1:], strict=False))


def forest(link: np.ndarray) -> np.ndarray:
    """The smallest row number that each row reaches over a symmetric link matrix."""
    n = len(link)
    label = np.arange(n)
    while True:
        lower = label.copy()
        for lo in range(0, n, 512):
            lower[lo : lo + 512] = np.minimum(lower[lo : lo + 512], np.where(link[lo : lo + 512], label[None, :], n).min(axis=1, initial=n))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def two_sided_forest(link: np.ndarray, strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row number that each row reaches over links of left rows (numbered first) with other, right rows."""
    left, right = np.arange(link.shape[0]), link.shape[0] + np.arange(link.shape[1])
    while True:
        x, y = left.copy(), right.copy()
        for lo in range(0, len(left), strip):
            part = link[lo : lo + strip]
            x[lo : lo + strip] = np.minimum(x[lo : lo + strip], np.where(part, y[None, :], len(left) + len(right)).min(axis=1, initial=len(left) + len(right)))
            y = np.minimum(y, np.where(part, x[lo : lo + strip, None], len(left) + len(right)).min(axis=0, initial=len(left) + len(right)))
        label = np.concatenate([x, y])
        label = label[label]
        x, y = label[: len(left)], label[len(left) :]
        if (x == left).all() and (y == right).all():
            return left, right
        left, right = x, y
