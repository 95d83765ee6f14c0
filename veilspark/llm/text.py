"""Vectorised word splitting and hashing over Arrow text buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, so UTF-8 text splits on ASCII white space only. Words are hashed
with a polynomial over the ring of 64-bit integers (prefix sums give every word of a buffer at once), windows of words
with the same scheme over the word hashes. Both pass a finaliser, so any bits of a hash may choose a partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once, and the length beyond which a word is hashed alone.
BLOCK = 1 << 20
LONG = 1 << 15
#: Words of a chunk that a map task sorts at once; a worker then stays under 400 MB.
CHUNK_WORDS = 1 << 19

# Workers live on between tasks: large arrays go back to the system when they are freed, where the C library can do so.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse."""
    if base not in _TABLES:
        n = BLOCK + 2 * LONG
        _TABLES[base] = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    return _TABLES[base]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the place of its first word (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = ~SPACE[data]
    gap = np.zeros(n + 1, dtype=bool)
    gap[0] = gap[n] = True
    gap[1:n] = ~word[:-1]
    gap[bounds] = True
    starts = np.flatnonzero(word & gap[:n])
    gap[:n] = ~word
    gap[bounds] = True
    ends = np.flatnonzero(word & gap[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ascending spans; fold lower-cases A-Z."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    up, down = tables(BYTE_BASE)
    i, n = 0, len(starts)
    long = np.flatnonzero(size > LONG)
    for k in long:
        x = data[starts[k] : ends[k]]
        out[k] = int.from_bytes(hashlib.blake2b((LOWER[x] if fold else x).tobytes(), digest_size=8).digest(), "little")
    stops = [*long.tolist(), n]
    for stop in stops:
        while i < stop:
            at = int(starts[i])
            j = min(stop, max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right"))))
            x = data[at : int(ends[j - 1])]
            value = BYTE_VALUE[LOWER[x] if fold else x]
            value *= up[: len(value)]
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value, out=total[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((total[e] - total[s]) * down[s] + size[i:j].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            i = j
        i = stop + 1
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The Rabin-Karp hash of every k consecutive entries."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    up, down = tables(WORD_BASE)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        x = words[i : j + k - 1] * up[: j + k - 1 - i]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        out[i:j] = mix((total[k:] - total[:-k]) * down[: j - i])
    return out


def doc_windows(words: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows that lie within one text, and the place of each text's first."""
    own = np.maximum(np.diff(ptr) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(own)])
    at = np.repeat(ptr[:-1] - first[:-1], own) + np.arange(first[-1])
    return windows(words, k)[at] if first[-1] else np.zeros(0, np.uint64), first


def packed(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers as compressed byte planes; delta for ascending ones."""
    if delta and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes()
    small = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
    return len(planes).to_bytes(8, "little") + small


def unpacked(blob: bytes, dtype, delta: bool = False) -> np.ndarray:
    total = int.from_bytes(blob[:8], "little")
    if not total:
        return np.zeros(0, dtype)
    planes = pa.decompress(blob[8:], decompressed_size=total, codec="zstd", asbytes=True)
    size = np.dtype(dtype).itemsize
    out = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(out, dtype=dtype) if delta else out
