"""Whole columns of text as NumPy arrays: words, hashes and per-row groups without a loop per word.

Everything works on the UTF-8 bytes of an Arrow column, in pieces of about ``PIECE`` bytes that
never split a row. Memory of a piece is about 60 bytes per byte of text; a longer row is a piece
of its own.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
U64 = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    v = np.asarray(values, dtype=U64).copy()
    v ^= v >> U64(30)
    v *= U64(0xBF58476D1CE4E5B9)
    v ^= v >> U64(27)
    v *= U64(0x94D049BB133111EB)
    v ^= v >> U64(31)
    return v


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BASE = int(constants(1, 11)[0])
#: A number for each byte; capital letters share those of the small ones in ``LOWER``.
EXACT = constants(256, 77)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k below n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for place, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table = np.full(size, U64(base), dtype=U64)
            table[0] = 1
            _powers[place] = np.cumprod(table, dtype=U64)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    begin = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, begin


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row begins from 0) of runs of rows of about ``size`` bytes."""
    data, begin = text_buffers(column)
    rows, first = len(begin) - 1, 0
    while first < rows:
        end = int(np.searchsorted(begin, begin[first] + size, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[begin[first] : begin[end]], begin[first : end + 1] - begin[first]
        first = end


def spans(inside: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within rows: starts, ends, and the first run of each row (one more entry)."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(begin), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[begin[:-1][begin[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begin[1:][begin[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, begin)


class Runs:
    """Hashes of runs of 64-bit values, each in constant time: equal runs have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(U64) * LENGTHS)

    def without(self, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Hashes of the runs without the value at ``gone``; equal to ``hashes`` of the shorter run."""
        rest = (self.total[ends] - self.total[gone + 1]) * U64(pow(BASE, -1, 1 << 64))
        raw = (self.total[gone] - self.total[starts] + rest) * self.down[starts]
        return mix(raw + (ends - starts - 1).astype(U64) * LENGTHS)


LENGTHS = U64(0x9E3779B97F4A7C15)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes (by ``table``) have equal hashes."""
    return Runs(table[data]).hashes(starts, ends) if len(starts) else np.zeros(0, U64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    marks = np.zeros(256, bool)
    for low, high in ranges:
        marks[low : high + 1] = True
    return marks


#: Everything but space and \t \n \v \f \r.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and every byte of a character beyond ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

PLACES = constants(8, 5)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row and where each row begins among them.

    A row of fewer words gives its whole sequence as one, a row without words none.
    """
    count = np.diff(first)
    n = len(words)
    out_count = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(out_count)))
    if not n:
        return np.zeros(0, U64), begin
    padded = np.concatenate((words, np.zeros(size, U64)))
    sums = np.zeros(n, U64)
    for k in range(size):
        sums += padded[k : k + n] * PLACES[k]
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], out_count) + np.repeat(first[:-1], out_count)
    found = sums[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = count[short] > k
            own[has] += words[first[short][has] + k] * PLACES[k]
        found[begin[short]] = own + count[short].astype(U64) * PLACES[size]
    return mix(found), begin


def per_row_unique(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new row begins."""
    rows = [np.unique(values[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    count = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.concatenate(rows) if rows else np.zeros(0, U64)
    return flat, np.concatenate(([0], np.cumsum(count)))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int64).view(U64)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] of them), then the same for the next entry."""
    total = np.concatenate(([0], np.cumsum(count)))
    return np.arange(total[-1]) - np.repeat(total[:-1], count) + np.repeat(begin, count)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


@contextlib.contextmanager
def quiet():
    """64-bit arithmetic wraps around on purpose."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        yield
