"""Vectorised text kernel: words and their hashes straight from Arrow buffers.

A batch of texts is looked at as one array of UTF-8 bytes.  Words are found and
hashed with a handful of numpy passes, so no Python object is made for a word.
Batches are cut into blocks of about ``BLOCK`` bytes; a longer text is a block of
its own and is always taken whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Constants of the two hashes of spans: for sizes, for lanes, and for places of lanes.
_SEEDS = ((0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xA24BAED4963EE407), (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x2545F4914F6CDD1D))
#: Spans of up to so many lanes of eight bytes are hashed lane after lane, longer ones by sums over all lanes.
_CHAIN = 128


@dataclass
class Words:
    """Words of the texts ``first``..``first + n`` of a batch."""

    first: int
    n: int
    buf: np.ndarray  # bytes
    offsets: np.ndarray  # n + 1 places in buf
    start: np.ndarray  # of words, in buf
    end: np.ndarray
    bounds: np.ndarray  # n + 1: words of text i are bounds[i]..bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes have equal hashes in any block.

    A span is taken in lanes of eight bytes.  Every lane goes through a bijection that depends on
    the size, and on all lanes before (spans of few lanes) or on its place (longer ones), so no
    arrangement of bytes is alike in itself.  ``second`` gives another hash with other constants for
    all of that: what meets in one doesn't in the other, and both together identify a span.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    of_size, of_lane, of_place = (_U(x) for x in _SEEDS[second])
    size = (end - start).astype(np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        h = mix64((eights[start] & mask[np.minimum(size, 8)]) * of_lane + size.astype(np.uint64) * of_size + of_place)
        more = np.flatnonzero((size > 8) & (size <= 8 * _CHAIN))
        for lane in range(1, _CHAIN):
            more = more[size[more] > 8 * lane]
            if not len(more):
                break
            part = eights[start[more] + 8 * lane] & mask[np.minimum(size[more] - 8 * lane, 8)]
            h[more] = mix64(h[more] * of_lane + mix64(part + of_place))
        for i in np.flatnonzero(size > 8 * _CHAIN).tolist():
            for a in range(8, int(size[i]), BLOCK):
                n = -(-min(int(size[i]) - a, BLOCK) // 8)
                at = int(start[i]) + a + 8 * np.arange(n)
                part = eights[at] & mask[np.minimum(int(end[i]) - at, 8)]
                place = mix64((np.arange(n, dtype=np.uint64) + _U(a // 8)) * of_place + of_size)
                h[i] += mix64(mix64(part * of_lane + of_size) + place).sum(dtype=np.uint64)
        return mix64(h + of_size)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def _trimmer():
    """The C library's function that gives freed memory back, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


_trim = _trimmer()


def release_memory() -> None:
    """Gives back what a batch has freed: Python workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def byte_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, n, bytes, offsets) of runs of whole texts of about ``block`` bytes."""
    buf, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        j = min(j, n)
        yield i, j - i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release_memory()


def find_words(first: int, n: int, buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes other than space and 0x09 to 0x0D, within each text."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(first, n, buf, offsets, none, none, np.zeros(n + 1, np.int64))
    inside = ~_SPACE[buf]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    at = offsets[full]
    starts[at] = inside[at]
    at = offsets[full + 1] - 1
    ends[at] = inside[at]
    start = np.flatnonzero(starts)
    return Words(first, n, buf, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def word_blocks(column: pa.Array, lower: bool = True, block: int = BLOCK) -> Iterator[Words]:
    """Words of a string column, block by block; ``lower`` maps A-Z to a-z only."""
    for first, n, buf, offsets in byte_blocks(column, block):
        yield find_words(first, n, _LOWER[buf] if lower else buf, offsets)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and n + 1 bounds.

    A text of 1 to k - 1 words has its whole sequence as the only shingle; a text
    without words has none.
    """
    h = w.hashes()
    weights = mix64(np.arange(1, k + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)
    counts = w.counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(made)])
    begin = np.repeat(w.bounds[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(counts, k), made)
    with np.errstate(over="ignore"):
        acc = length.astype(np.uint64) * _U(0x9FB21C651E98DF25)
        for i in range(k):
            if len(h):
                part = h[np.minimum(begin + i, len(h) - 1)] * weights[i]
                acc += np.where(length > i, part, _U(0))
    return mix64(acc), bounds
