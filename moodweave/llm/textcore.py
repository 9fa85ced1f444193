"""Vectorised text primitives over Arrow string buffers.

Every function works on a run of documents laid end to end: one byte array and the offsets of the documents in it.
Nothing loops over words in Python.  Hashes are 64-bit and depend only on the bytes hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

#: A byte is part of a "plain" word unless it is ASCII white space (code points 9 to 13 and 32).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: A byte is part of an "alphanumeric" word if it is an ASCII letter or digit, or belongs to a non-ASCII character.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _PINV)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `most` bytes (a longer document is a run of its own): first, end, bytes, offsets."""
    data, off = utf8(column)
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, never across documents, and the documents' offsets into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands.  Spans are in order and don't overlap; they are taken about
    BLOCK_BYTES at a time, so a very long document needs no more memory than a block."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        low, a, b = starts[i], starts[i:j] - starts[i], ends[i:j] - starts[i]
        part = data[low : ends[j - 1]]
        p, pinv = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * p[: len(part)], dtype=U64, out=sums[1:])
        out[i:j] = mix((sums[b] - sums[a]) * pinv[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingles(hashes: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words of each document, in order; a document of fewer words (but some) has one, of all its words."""
    counts = np.diff(woff)
    have = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    off = np.concatenate([[0], np.cumsum(have)])
    n = len(hashes)
    out = np.zeros(n, U64)
    if n >= k:
        acc = np.zeros(n - k + 1, U64)
        for j in range(k):
            acc = (acc + hashes[j : n - k + 1 + j]) * U64(_P)
        out[: n - k + 1] = mix(acc)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        acc = 0
        for h in hashes[woff[d] : woff[d + 1]].tolist():
            acc = ((acc ^ h) * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF
        out[woff[d]] = acc
    at = np.repeat(woff[:-1] - off[:-1], have) + np.arange(off[-1])
    return out[at], off


def uniform32(x: np.ndarray) -> np.ndarray:
    """Float32 in (0, 1) from the low 24 bits."""
    return ((x & U64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
