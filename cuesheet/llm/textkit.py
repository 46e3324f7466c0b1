"""Vectorised word hashing over Arrow string columns (numpy, inside Spark tasks).

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D),
compared after lower-casing A-Z. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
KEPT = 4 << 20
_powers = np.ones(1, dtype=U)
_inverse = np.ones(1, dtype=U)


def tidy(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives its freed memory back to the system at its end: Python workers are used again, and would keep it."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown when a longer chunk comes; those of very long chunks aren't kept."""
    global _powers, _inverse
    if len(_powers) >= n:
        return _powers, _inverse
    made = []
    for base in (_BASE, U(pow(int(_BASE), -1, 1 << 64))):
        steps = np.full(n, base, dtype=U)
        steps[0] = U(1)
        made.append(np.multiply.accumulate(steps, out=steps))
    if n <= KEPT:
        _powers, _inverse = made
    return made[0], made[1]


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) pieces of whole rows with about limit bytes each; a longer row comes alone."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    lengths = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))
    ends, start, at, n = np.cumsum(lengths), 0, 0.0, len(column)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, at + limit, side="right")))
        yield start, column.slice(start, stop - start)
        start, at = stop, float(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' UTF-8 bytes end to end, and n + 1 offsets; null rows are empty."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of maximal runs of one kind (0: no run) that don't cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    inside = kind[at[:-1]] != 0
    return at[:-1][inside], at[1:][inside]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, from prefix sums of one rolling polynomial."""
    power, inverse = _tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in row order, and n + 1 offsets of the rows into them."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends = runs(data, offsets, (~_SPACE[data]).view(np.uint8))
    return hash_runs(data, starts, ends), np.searchsorted(starts, offsets)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like words(), for runs of letters and digits; all non-ASCII bytes count as letters."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends = runs(data, offsets, _LETTER[data])
    return hash_runs(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and row offsets. A row of 1 to k-1 words is one shingle; without words it has none."""
    n, counts = len(hashes), np.diff(offsets)
    if n >= k:
        made = hashes[: n - k + 1] * U(0xD6E8FEB86659FD93)
        for j in range(1, k):
            made = mix(made) + hashes[j : n - k + 1 + j] * U(0xD6E8FEB86659FD93)
        made = mix(made)
    else:
        made = np.zeros(0, dtype=U)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = row[: len(made)] == row[k - 1 :] if len(made) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return made[whole], np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))))
    extra = np.array([hash_sequence(hashes[offsets[i] : offsets[i + 1]]) for i in short], dtype=U)
    rows = np.concatenate((row[: len(made)][whole], short))
    order = np.argsort(rows, kind="stable")
    sizes = np.bincount(rows, minlength=len(counts))
    return np.concatenate((made[whole], extra))[order], np.concatenate(([0], np.cumsum(sizes)))


def hash_sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of one short word sequence; its length counts."""
    value = mix(np.array([len(hashes)], dtype=U))
    for scaled in hashes * U(0xD6E8FEB86659FD93):
        value = mix(value + scaled)
    return value[0]
