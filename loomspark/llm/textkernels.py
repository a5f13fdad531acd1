"""NumPy kernels over the bytes of whole Arrow text columns.

An Arrow string column is one byte buffer and one offset array, so words, shingles and n-grams of thousands of
texts are found with a few array passes and no Python loop over rows. Texts are cut into slices of about
``SLICE`` bytes, on row borders only, which keeps the temporary arrays small; a longer text is one slice. What the
arrays of a batch have taken goes back to the system when the batch is done, as a worker lives on between tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public SplitMix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * _BASE)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return seeds(256, 7)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Two multipliers for two independent hashes; odd, so that they have an inverse mod 2**64.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_P = _BASES[0]


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i mod 2**64 for i < n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        made = []
        for p in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
            a = np.full(max(n, SLICE + 4096), p, dtype=U64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=U64))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def prefix_hash(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * P**i, one longer than values."""
    up, _ = powers(len(values) + 1, base)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of each [start, end), equal for equal contents at any place."""
    _, down = powers(len(prefix), base)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * _BASE)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The byte buffer and int64 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, or something that does nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``most`` bytes each."""
    data, offsets = column_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    if len(data) > SLICE:
        give_back()


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space, and the first word of each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z in lower case, their starts and ends, and the first word of each text."""
    starts, ends, first = spans_of_words(data, offsets)
    prefix = prefix_hash(_byte_values()[LOWER[data]])
    return range_hash(prefix, starts, ends), starts, ends, first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words on end, without regard to the borders of texts; len(words) - k + 1 of them."""
    if len(words) < k:
        return np.zeros(0, U64)
    n = len(words) - k + 1
    out = np.full(n, U64(k), dtype=U64)
    for i in range(k):
        out *= U64(_P)
        out += words[i : i + n]
    return mix(out)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; the whole sequence as one if it has fewer words; empty without words."""
    every = shingle_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield shingle_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, U64)
