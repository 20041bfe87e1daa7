"""Array-at-a-time tokenising and hashing of Arrow string columns.

All texts of a chunk are handled as one byte buffer. Words are maximal runs of word bytes; a
word's hash takes its bytes in blocks of 8, for all words of the chunk at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64


@lru_cache(1)
def _trim() -> Callable:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def trim() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(run: Callable) -> Callable:
    """``run``, a generator over batches, which gives the memory it no longer uses back to the system at its end: workers live on between tasks."""

    @wraps(run)
    def own(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return own
BASE = U64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and every byte of a non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALPHANUMERIC[_a:_b] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

#: Keeps the first n bytes of a little-endian block of 8.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


@lru_cache(None)
def _table(word_bytes: bytes, fold: bytes) -> bytes:
    """What each byte counts as in a word; 0 outside words. A NUL in a word counts as a space, which no word has."""
    return bytes((fold[i] or 32) if word_bytes[i] else 0 for i in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACE_SEPARATED, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words before each row) of all words; the last has one more entry than rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, np.zeros(len(offsets), np.int64)
    codes = np.zeros(n + 8, np.uint8)
    codes[:n] = np.frombuffer(data.tobytes().translate(_table(word_bytes.tobytes(), fold.tobytes())), np.uint8)
    inside = codes[:n] != 0
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(begins)
    first[n] = True
    begins[:] = inside
    begins[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(begins) + 1
    left = ends - starts
    blocks = np.ndarray((n,), "<u8", codes.data, strides=(1,))
    hashes = (left.astype(U64) + U64(0xD6E8FEB86659FD93)) * BASE
    hashes = mix(hashes ^ (blocks[starts] & _MASKS[np.minimum(left, 8)]))
    more, at = np.flatnonzero(left > 8), 8
    while len(more):
        rest = left[more] - at
        hashes[more] = mix(hashes[more] * BASE + (blocks[starts[more] + at] & _MASKS[np.minimum(rest, 8)]))
        more, at = more[rest > 8], at + 8
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def repeat_rows(before: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def combine(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """An order-sensitive hash of aligned hash arrays."""
    out = np.full(len(parts[0]), salt, U64)
    for i, part in enumerate(parts):
        out = out * BASE + part * U64((2 * i + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1 | 1)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
