"""Vectorised byte, word and shingle kernels used inside Arrow tasks.

All functions work on one Arrow string column of a batch at once: its data buffer is one NumPy byte array and its
offsets mark the documents.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once: small enough that the 64-bit temporaries stay in cache.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240611)
_BASE = np.uint64(int(_rng.integers(1 << 62, (1 << 63) - 1)) * 2 + 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = _rng.integers(1, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, (1 << 63) - 1, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The word separators of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither a letter nor a digit; bytes of other scripts count as letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base, grown on demand (one long document may exceed a slice)."""

    n = 0

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, 2 * SLICE_BYTES)
            cls.up, cls.down = _powers(_BASE, cls.n), _powers(_BASE_INV, cls.n)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte array and int64 offsets of a string column; nulls become empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and, for each document, the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z folded to a-z."""
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[LOWER][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each document, and each document's first index among them.

    A document with fewer words is one shingle of all its words; without words it has none.
    """
    counts = np.diff(firsts)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(each)))
    n = len(hashes)
    full = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        full += hashes[j : j + len(full)] * _PLACE[j]
    out = np.zeros(bounds[-1], np.uint64)
    index = np.arange(bounds[-1]) + np.repeat(firsts[:-1] - bounds[:-1], each)
    short = np.repeat(counts < width, each)
    out[~short] = full[index[~short]]
    for doc in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = firsts[doc], firsts[doc + 1]
        out[bounds[doc]] = (np.append(hashes[a:b], np.uint64(b - a)) * np.append(_PLACE[: b - a], _PLACE[15])).sum(dtype=np.uint64)
    return mix(out), bounds


def shingles(column: pa.Array, width: int, breaks: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, bounds) for successive row ranges of a string column."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, firsts = words(part, off, breaks)
        hashes, bounds = shingle_hashes(word_hashes(part, starts, ends), firsts, width)
        yield a, hashes, bounds
