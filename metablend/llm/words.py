"""Words of whole Arrow text columns, found with array operations on the UTF-8 bytes.

A word is a maximal run of bytes that are digits, letters a-z after lower-casing
A-Z, or above 0x7F (every non-ASCII character): the class
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on lower-cased text.  Texts are handled in
slices of whole documents of a few MB, so memory stays bounded by the slice or
by the one longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_KEY = b"metablend words"
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes
MIXED_BYTES = 64

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[ord("0"):ord("9") + 1] = True
IS_WORD[ord("a"):ord("z") + 1] = True
IS_WORD[ord("A"):ord("Z") + 1] = True
IS_WORD[0x80:] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A"):ord("Z") + 1] += 32

def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (fixed public constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of rows ``row0 .. row0+n_rows-1`` of a text column, in text order."""
    row0: int
    n_rows: int
    buf: np.ndarray      # bytes of the slice
    offsets: np.ndarray  # n_rows + 1 text starts in ``buf``
    row: np.ndarray      # row of each word, from 0
    start: np.ndarray    # byte range of each word in ``buf``
    end: np.ndarray
    hash: np.ndarray     # uint64 of the lower-cased bytes


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a text column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def slices(offsets: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each (one longer text alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_slices(col: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    buf, offsets = text_buffers(col)
    for a, b in slices(offsets, max_bytes):
        yield words_of(a, buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def words_of(row0: int, buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    n_rows = len(offsets) - 1
    if not n:
        z = np.zeros(0, np.int64)
        return Words(row0, n_rows, buf, offsets, z, z, z, np.zeros(0, np.uint64))
    is_word = IS_WORD[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = is_word[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(row0, n_rows, buf, offsets, row, start, end, range_hash(TO_LOWER[buf], start, end))


def range_hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of byte ranges, the same wherever the bytes stand.

    Ranges of up to ``MIXED_BYTES`` go eight bytes at a time through a mixing step, all ranges side by
    side; longer ones (few in a slice, by their length) through keyed BLAKE2b.  Memory is a copy of
    the slice and a few values per range; nothing is kept between calls."""
    size = end - start
    out = mix64(size.astype(np.uint64) * _MULT)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([low, np.zeros(8, np.uint8)]), 8)
    left = np.flatnonzero(size <= MIXED_BYTES)
    for at in range(0, MIXED_BYTES, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        block = np.ascontiguousarray(eight[start[left] + at]).view("<u8").ravel() & _FIRST[np.minimum(size[left] - at, 8)]
        out[left] = mix64((out[left] ^ block) * _MULT + np.uint64(at))
    for i in np.flatnonzero(size > MIXED_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i]:end[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return out


def count_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)[:n].astype(np.int64)
