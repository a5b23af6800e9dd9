"""Whole texts as byte arrays: word bounds, word hashes and word shingles in numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; UTF-8 never has
these bytes inside a character, so byte runs and character runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in runs of about so many bytes, to bound a worker's memory.
RUN_BYTES = 1 << 19
#: Words longer than this are hashed one at a time.
LONG_WORD = 48

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of rows; null counts as empty."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word, in order."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.concatenate([[False], solid[:-1]])
    start = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate([solid[1:], [False]])
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first if asked."""
    buf = _LOWER[buf] if lower else buf
    n = end - start
    h = np.full(len(n), _OFFSET)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] <= LONG_WORD]
    s, left, g = start[order], n[order], h[order]
    live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for i, k in enumerate(live):
        g[:k] = (g[:k] ^ buf[s[:k] + i]) * _PRIME
    h[order] = g
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes())
    return mix(h ^ n.astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, rows: int, size: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of ``size`` words.

    A row with fewer words has one run, the whole of it; a row without words has none.
    """
    counts = np.bincount(row, minlength=rows)
    ends = np.cumsum(counts)
    s = h
    for j in range(1, size):
        if len(h) <= j:
            s = s[:0]
            break
        s = mix(s[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
    out = []
    for i in range(rows):
        a, n = ends[i] - counts[i], counts[i]
        if n >= size:
            out.append(np.unique(s[a : a + n - size + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for j in range(a, a + n):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
