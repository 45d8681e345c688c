"""Vectorised words over Arrow string columns.

A column becomes one byte buffer; white space splits it into words, and each word gets a 64-bit hash that is mixed
from its 8-byte lanes. All of it is numpy over slices of about ``SLICE_BYTES``, so a batch of long texts needs no more
memory than a batch of short ones (one text is never cut: a slice holds at least one).
Two different words share a hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from textloom.llm.common import SLICE_BYTES

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
LONG = 64
MASKS = np.array([(1 << (8 * k)) - 1 if k < 8 else 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes) for runs of rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (one more entry than rows)."""
    inside = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    now = np.zeros(n + 1, bool)
    now[:n] = inside
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * M3 + M2)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left, rows, at = size, None, starts
    for _ in range(LONG // 8):
        lane = lanes[at] & MASKS[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ lane) * M3
        else:
            out[rows] = mix(out[rows] ^ lane) * M3
        keep = np.flatnonzero(left > 8)
        if not len(keep):
            break
        rows, at, left = (keep if rows is None else rows[keep]), at[keep] + 8, left[keep] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return mix(out)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's words."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
