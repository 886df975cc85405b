"""Vectorised text primitives that the Arrow operators of this package share.

An Arrow string column is one UTF-8 buffer with offsets.  The functions here
work on slices of about ``CHUNK_BYTES`` of it with numpy, so that a worker's
memory does not depend on the Arrow batch size.  A single longer text is one
slice of its own: texts are never cut.

A word is ``[^\\x20\\x09-\\x0D]+``.  In UTF-8 these separators are single bytes
that occur in no other character, so words can be found bytewise.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def release() -> None:
    """Gives unused memory of the process back, which allocators keep for later otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def releasing(mapper: Callable) -> Callable:
    """A mapper of Arrow batches that leaves no unused memory to its worker, which waits for the next task."""

    @functools.wraps(mapper)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            release()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for mappers that make Python objects of them."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(lower: bool = False, zero_digits: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; bytes that count as equal share one."""
    same = np.arange(256, dtype=np.uint64)
    if lower:
        same[65:91] += np.uint64(32)
    if zero_digits:
        same[48:58] = 48
    return mix(same + np.uint64(0x51ED270B))


EXACT = byte_values()
LOWER = byte_values(lower=True)
LINE = byte_values(lower=True, zero_digits=True)

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], which do not depend on where they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(batch: pa.RecordBatch, column: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        end = min(end, row + 20_000)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the row of each."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    word = IS_WORD[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True  # an empty text at the end marks the spare place
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    first[-1] = True
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def shingles(words: np.ndarray, row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words in one row, and the index of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = (total + words[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(29)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(total[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles, A-Z lower-cased.

    A row of fewer than ``width`` words has its whole sequence as its only
    shingle; a row without words has none.
    """
    starts, ends, row = word_spans(data, offsets)
    words = range_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    hashed, at = shingles(words, row, width)
    n = len(offsets) - 1
    cut = np.searchsorted(row[at], np.arange(n + 1)) if len(at) else np.zeros(n + 1, dtype=np.int64)
    by_row = np.searchsorted(row, np.arange(n + 1))
    for k in range(n):
        own = hashed[cut[k] : cut[k + 1]]
        if len(own):
            own = np.sort(own)
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif by_row[k] < by_row[k + 1]:
            few = words[by_row[k] : by_row[k + 1]]
            yield range_hashes(few, np.zeros(1, dtype=np.int64), np.array([len(few)]))
        else:
            yield own
