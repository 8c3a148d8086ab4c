"""Vectorised text helpers for Arrow batches: words, 64-bit word hashes, k-word windows.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps those six
bytes out of multi-byte characters, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20  # text bytes handled at once; one longer document is handled whole
LONG_WORD = 256  # bytes; longer words are hashed by xxhash

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PHI = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (overwrites and returns ``x``)."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) pieces of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of each document's words."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~IS_SPACE[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of every word buf[s:e]."""
    size = (e - s).astype(np.uint64)
    h = mix64(size * _PHI)
    if len(s) == 0:
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    left = (e - s).astype(np.int64)
    at = s.astype(np.int64)
    long = left > LONG_WORD
    idx = np.flatnonzero(~long) if long.any() else None
    while True:
        rest = left if idx is None else left[idx]
        load = eight[at if idx is None else at[idx]]
        cut = (8 - np.minimum(rest, 8)).astype(np.uint64) * np.uint64(8)
        load &= np.uint64(0xFFFFFFFFFFFFFFFF) >> cut
        if idx is None:
            h = mix64((h ^ load) * _PHI + _M2)
        else:
            h[idx] = mix64((h[idx] ^ load) * _PHI + _M2)
        at, left = at + 8, left - 8
        more = left > 0
        if long.any():
            more &= ~long
        idx = np.flatnonzero(more)
        if len(idx) == 0:
            break
    raw = buf.data if long.any() else None
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh64_intdigest(bytes(raw[s[i] : e[i]]))
    return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (length ``len(h) - k + 1``), before mixing."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    out, done, size, part = None, 0, 1, h
    rest = k
    while rest:
        if rest & 1:
            piece = part[done : done + len(h) - k + 1]
            mul = np.uint64(pow(base, size, 1 << 64))
            out = piece.copy() if out is None else out * mul + piece
            done += size
        rest >>= 1
        if rest:
            part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return mix64(out)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document (A-Z lower-cased).

    Fewer than ``k`` words: the whole sequence is one shingle; no words: empty.
    """
    low = LOWER[buf]
    s, e, first = word_bounds(low, offs)
    h = word_hashes(low, s, e)
    w = windows(h, k)
    for d in range(len(offs) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield np.unique(w[a : b - k + 1])
        elif b > a:
            yield mix64(windows(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
