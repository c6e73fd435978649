"""Vectorised helpers for whole texts in Arrow batches: chunks of UTF-8 bytes, word spans, hashes.

Texts are handled in chunks of about ``CHUNK`` bytes, so that working memory depends on the
chunk (or on the longest single text), not on how many rows a batch has.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _accumulated(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _accumulated(_BASE, size), _accumulated(_INVERSE, size)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    size = CHUNK + (CHUNK >> 2)
    if n > size:  # one very long text: not kept
        return _accumulated(_BASE, n), _accumulated(_INVERSE, n)
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64's finalizer); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes up to which a span is hashed limb by limb; a longer one gets a keyless BLAKE2b.
_LIMBWISE = 256


def _limbs(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))


def _masked(limbs: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next limb of spans with ``left`` bytes to go, zeros beyond their ends."""
    beyond = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
    return limbs[starts] << beyond >> beyond


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of any length; no two spans of up to eight bytes and one length collide.

    Unlike polynomials modulo 2^64 these have no pairs of texts that collide for every base.
    """
    starts, size = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    limbs = _limbs(data)
    out = mix(size.astype(np.uint64) + np.uint64(_BASE))
    going = np.flatnonzero((size > 0) & (size <= _LIMBWISE))
    for at in range(0, _LIMBWISE, 8):
        if not len(going):
            break
        out[going] = mix(out[going] ^ _masked(limbs, starts[going] + at, size[going] - at))
        going = going[size[going] > at + 8]
    long = np.flatnonzero(size > _LIMBWISE)
    for k, a, b in zip(long.tolist(), starts[long].tolist(), (starts[long] + size[long]).tolist()):
        out[k] = int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little")
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, which)``: one span for each distinct content, and for each span the place of its content
    in ``first``.  Hashes only sort: contents are compared byte by byte."""
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    twin = first[which]
    size, limbs = ends - starts, _limbs(data)
    wrong = size != size[twin]
    going = np.flatnonzero((twin != np.arange(len(twin))) & ~wrong & (size <= _LIMBWISE))
    for at in range(0, _LIMBWISE, 8):
        if not len(going):
            break
        left = size[going] - at
        same = _masked(limbs, starts[going] + at, left) == _masked(limbs, starts[twin[going]] + at, left)
        wrong[going[~same]] = True
        going = going[same & (left > 8)]
    for k in np.flatnonzero((twin != np.arange(len(twin))) & ~wrong & (size > _LIMBWISE)).tolist():
        wrong[k] = not np.array_equal(data[starts[k] : ends[k]], data[starts[twin[k]] : ends[twin[k]]])
    if wrong.any():  # hashes that met by chance
        held: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(wrong).tolist():
            own = data[starts[k] : ends[k]].tobytes()
            if own not in held:
                held[own] = len(first) + len(more)
                more.append(k)
            which[k] = held[own]
        first = np.concatenate((first, np.array(more, first.dtype)))
    return first, which


class Rolling:
    """Polynomial hashes modulo 2^64 of any spans of ``data``; equal bytes, equal hash.

    For short spans only: from 1,024 bytes on there are texts that collide for every base.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= self.power[:n]
        np.cumsum(values, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.inverse[starts]
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and its rows' offsets; a null is empty."""
    n = len(column)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)``, each of about ``size`` bytes or one row."""
    data, at = utf8(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1))
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


@lru_cache(maxsize=1)
def _malloc_trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def trim() -> None:
    """Give free memory back to the machine; both allocators would keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; free memory goes back after each, and what the task held after the last."""
    for batch in batches:
        yield batch
        del batch
        trim()
    gc.collect()
    trim()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` (by byte value) holds, never across rows.

    Returns the runs' starts and ends, and for each row the number of its first run, with the
    number of all runs at the end.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    held = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = held[:-1]
    starts = np.flatnonzero(held & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = held[1:]
    ends = np.flatnonzero(held & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the slices ``[start, start + length)``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def set_of(values: str | bytes) -> np.ndarray:
    """A table by byte value of the bytes in ``values``."""
    out = np.zeros(256, bool)
    out[list(values.encode("latin-1") if isinstance(values, str) else values)] = True
    return out
