"""Vectorised text kernels: whole Arrow string columns to word and n-gram hashes, with numpy only.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Work goes over slices of half a megabyte of whole
documents, so memory follows the slice (or the longest single document), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 1 << 19
_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_ROOT), -1, 1 << 64))

_rng = np.random.Generator(np.random.PCG64(20240501))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
            have[0] = 1
            np.cumprod(have, out=have)
        if len(have) <= 16 * SLICE_BYTES:
            _powers[key] = have
    return have


def trim() -> None:
    """Gives freed memory back to the system, for the workers that wait while others run."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together; a longer document is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the documents between ``offsets``, and the place of each document's first word."""
    base = int(offsets[0])
    data = raw[base : int(offsets[-1])]
    rel = np.asarray(offsets) - base
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(rel), np.int64)
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = rel[:-1][rel[:-1] < len(data)]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = rel[1:][rel[1:] > 0] - 1
    last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(rel), np.int64)
    with np.errstate(over="ignore"):
        run = (_CODE_LOWER if lower else _CODE)[data]
        run *= _power(_ROOT, len(data))[: len(data)]
        np.cumsum(run, out=run)
        h = run[end]
        before = start > 0
        h[before] -= run[start[before] - 1]
        h *= _power(_INV, len(data))[start]
        h += (end - start).astype(np.uint64) * _U(0xA0761D6478BD642F)
        h = mix(h)
    return h, np.searchsorted(start, rel)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that begin at each word; the last n - 1 run past the end and are left out."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[:m] + _U(n)
        for k in range(1, n):
            g = (g ^ (g >> _U(31))) * _U(0x9FB21C651E98DF25) + h[k : k + m]
        return mix(g)


def pack(x: np.ndarray) -> bytes:
    """Integers as zstd over their byte planes; planes of zeros cost nothing."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, dtype) -> np.ndarray:
    """What ``pack`` was given."""
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(data, dtype), dtype=dtype)
