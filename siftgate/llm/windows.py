"""Numpy kernels for fixed-length windows over sequences (bytes or words) of many documents at once.

Hashes are built by doubling: the hash of 2m elements mixes those of its halves, so every length up to the
window costs a logarithmic number of passes. Each window has an *owner*, the leftmost least hash among the
short strings at its first ``w`` positions. The owner follows from the window's content alone, so equal
windows have equal owners, and neighbouring windows mostly share one: an index of owners stands for the index
of all windows at a small part of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
MULT_A, MULT_B, MULT_C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
TOP = U(0xFFFFFFFFFFFFFFFF)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Not linear, so that no pattern of repeated halves cancels out."""
    x = a * MULT_A
    x ^= x >> U(29)
    x += b * MULT_B
    x ^= x >> U(32)
    x *= MULT_C
    x ^= x >> U(31)
    return x


def double(h: np.ndarray, m: int) -> np.ndarray:
    """From hashes of m elements those of 2m; past the end the result is cut."""
    return mix(h[: max(0, len(h) - m)], h[m:])


def owners(h: np.ndarray, w: int) -> np.ndarray:
    """For each i the leftmost position of the least of h[i : i + w]."""
    v, at, have = h, np.arange(len(h), dtype=np.int64), 1
    while have < w:
        step = min(have, w - have)
        n = len(v) - step
        if n <= 0:
            return np.empty(0, np.int64)
        less = v[step:] < v[:n]
        v, at = np.where(less, v[step:], v[:n]), np.where(less, at[step:], at[:n])
        have += step
    return at


def runs(starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index (into ``starts``, increasing positions) of the runs that are adjacent and share an owner."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, (starts[1:] != starts[:-1] + 1) | (own[1:] != own[:-1])]
    first = np.flatnonzero(new)
    return first, np.r_[first[1:], len(starts)] - 1


def chunks(column: pa.ChunkedArray | pa.Array, most: int):
    """Slices of a string column as (first row, end row, bytes, offsets from 0), of about ``most`` bytes or one text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def left_over(offsets: np.ndarray) -> np.ndarray:
    """For each element how many its document has from there on."""
    return np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by keys (first is most significant) and, in that order, where a new key starts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    return order, new


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) as maximal runs."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))
