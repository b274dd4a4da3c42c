"""Words of Arrow text columns as numpy arrays.

Texts are handled as the bytes of an Arrow batch, a megabyte or so at a time and never
cut: word borders, hashes and n-gram hashes are array operations over all texts of a
slice.  A word is a run of bytes outside ``0x20`` and ``0x09-0x0D``.

Hashes are 64-bit polynomials over random byte values, mixed at the end.  Two different
words of one corpus share a hash with a chance of about (distinct words)^2 / 2^65.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base & _MASK, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = x ^ np.uint64((salt * 0xD1342543DE82EF95) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Slice:
    """Consecutive texts of a batch: rows ``first`` to ``first + rows`` - 1."""

    first: int
    rows: int
    data: np.ndarray  # bytes of these texts
    bounds: np.ndarray  # byte bounds of the texts, rows + 1


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of whole texts of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    blob = buffers[2]
    data = np.frombuffer(blob, dtype=np.uint8) if blob is not None and blob.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        low, high = int(offsets[row]), int(offsets[end])
        yield Slice(row, end - row, data[low:high], offsets[row : end + 1] - low)
        row = end


def edges(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``inside`` that never cross a text border."""
    n = len(inside)
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    cuts = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; ``values`` are per-byte uint64 values."""
    n = len(values)
    size = SLICE_BYTES + 1
    while size < n + 1:
        size *= 2
    power, inverse = _powers(size)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * power[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    """Random value of each byte, as ``span_hashes`` takes them."""
    return _VALUES[data]


@dataclass
class Words:
    """Words of a slice, in order."""

    hashes: np.ndarray  # uint64
    starts: np.ndarray  # byte positions in the slice
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    bounds: np.ndarray  # word bounds of the texts, rows + 1


def words(part: Slice, lower: bool = True) -> Words:
    """Words of a slice, A-Z in lower case when ``lower`` is set."""
    if not len(part.data):
        empty = np.zeros(0, dtype=np.int64)
        zeros = np.zeros(part.rows, dtype=np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, zeros, np.zeros(part.rows + 1, np.int64))
    starts, ends = edges(~IS_SPACE[part.data], part.bounds)
    values = byte_values(LOWER[part.data] if lower else part.data)
    bounds = np.searchsorted(starts, part.bounds)
    return Words(span_hashes(values, starts, ends), starts, ends, np.diff(bounds), bounds)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` hashes; callers drop windows that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    power, _ = _powers(SLICE_BYTES + 1)
    size = len(hashes) - n + 1
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * power[k + 1]
    return mix(total, n)
