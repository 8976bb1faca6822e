"""Small numpy helpers over Arrow text columns, used inside Spark tasks.

A text column is seen as one byte buffer plus offsets, so that words, windows
and their fingerprints are computed for many documents at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes, which bounds memory.
RUN_BYTES = 1 << 18
#: doc_id that stands for a null one: after every other.
NO_ID = np.iinfo(np.int64).max

_ODD = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, RUN_BYTES + (1 << 16))
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def give_back() -> None:
    """Return memory that is free again to the system; else a worker keeps what its largest batch took through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False), np.int64)


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents in runs: first, end, their bytes, their offsets."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: Bytes of words: all but ASCII white space (20 and 09 to 0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Bytes of words: digits, ASCII letters and all of other scripts (upper case is folded first).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each document's first word (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 8))
    up, down = powers(len(data) + 1, _ODD)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A fingerprint of each window of so many words, by its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(words) + 1, base)
    total = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[size:] - total[:n]) * down[:n])


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Of all windows over joined documents, the first words of those that lie in one document."""
    n = int(first[-1])
    ok = np.zeros(max(n, 0) + 1, np.int64)
    have = np.diff(first) >= size
    np.add.at(ok, first[:-1][have], 1)
    np.add.at(ok, first[1:][have] - size + 1, -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of starts."""
    change = np.zeros(n + size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change)[:n] > 0


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value occurs in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in arrays sorted together, and their length at the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)
