"""Words of Arrow text columns as arrays of 64-bit hashes.

Texts are handled as UTF-8 bytes, many documents at a time. A word's hash is a
polynomial of its bytes modulo 2^64, taken from running sums over the buffer, and
mixed; it depends on the word only, not on the batch or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses
STEP = np.uint64(0xD1342543DE82EF95)
SLICE_BYTES = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling, in place of the input's copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=8)
def _powers_of(size: int, base: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def powers_of(n: int, base: int) -> np.ndarray:
    """The first ``n`` (at most 65,536) powers of a base modulo 2^64."""
    return _powers_of(1 << 16, base)[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    size = max(1 << 16, 1 << int(max(1, n - 1)).bit_length())
    return _powers_of(size, int(BASE)), _powers_of(size, pow(int(BASE), -1, 1 << 64))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; a missing text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0]: at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES, most: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes, ``most`` at once; a
    longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most, n)
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACES):
    """Start and end of each word, and the place of each document's first word."""
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def running(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers, one entry more than bytes."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(running(data), starts, ends)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, documents not regarded."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= STEP
        out += words[j: j + n]
    return mix(out)


def hashed_documents(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """For ranges of documents: first and last, word hashes, the place of each
    document's first word (one more than documents), and (bytes, starts, ends)."""
    data, offsets = text_buffer(texts)
    for lo, hi in slices(offsets):
        part = data[offsets[lo]: offsets[hi]]
        if lower:
            part = lower_ascii(part)
        at = offsets[lo: hi + 1] - offsets[lo]
        starts, ends, firsts = word_bounds(part, at)
        yield lo, hi, word_hashes(part, starts, ends), firsts, (part, starts, ends)
