"""Vectorised text helpers for Arrow batches (numpy only, used inside Spark tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Hashes are 64-bit polynomials over
random byte values (arithmetic modulo 2**64) followed by a bit mixer; they depend on the
content alone, so every task and every machine computes the same values.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the numpy helpers handle at once; a longer document is one chunk of its own.
CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD_BYTE = np.ones(256, dtype=bool)
_IS_WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_WORD_VALUES = np.where(_IS_WORD_BYTE, _BYTE_VALUES, np.uint64(0))
_LOWER_WORD_VALUES = _WORD_VALUES[_LOWER]
_STEP = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


#: Seconds between two returns of freed memory within a task.
RETURN_S = 0.25
_returned = [0.0]


def give_back(now: bool = False) -> None:
    """Hand freed memory back to the system: the allocators of Arrow and of the C library keep several times what a batch needs."""
    if not now and time.monotonic() - _returned[0] < RETURN_S:
        return
    _returned[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                # not glibc
        pass


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving memory back between batches and at the end of a task."""
    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            give_back()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        give_back(now=True)
    return lean_run


def lean_group(run: Callable) -> Callable:
    """``run`` for applyInArrow, giving memory back between groups."""
    def lean_run(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out
    return lean_run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the polynomial's base, and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(CHUNK_BYTES + 1, n + 1)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * CHUNK_BYTES:          # one very long document: do not keep its tables
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offs[0]:offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (at least one row): (first row, end row, bytes, offsets)."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


class Words:
    """Words of a chunk: start byte, hash, document, and word bounds of each document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        inside = _IS_WORD_BYTE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = offs[:-1][offs[:-1] < len(data)]
        first[at] = inside[at]
        self.inside, self.starts = inside, np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)
        if len(self.starts):
            power, inverse = powers(len(data))
            values = (_LOWER_WORD_VALUES if lower else _WORD_VALUES)[data]
            values *= power[:len(data)]
            self.hashes = mix(np.add.reduceat(values, self.starts) * inverse[self.starts])
        else:
            self.hashes = np.empty(0, np.uint64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``k`` words that lies inside one document."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += self.hashes[i:i + n] * _STEP[i]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, mix(h[at])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP[0])


def per_doc_sum(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte) over each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from arrays or lists, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def binary_slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary array whose i-th element is the raw memory of values[cuts[i]:cuts[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts, np.int64) * values.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8) if values.size else b"")])


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column as one array of ``dtype``, and the element count of each row."""
    data, offs = utf8(column)
    return np.frombuffer(data.tobytes(), dtype), np.diff(offs) // np.dtype(dtype).itemsize
