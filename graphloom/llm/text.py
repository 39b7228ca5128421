"""Vectorised tokenising and hashing of whole texts, straight on Arrow buffers.

Words are byte ranges of the UTF-8 data, so no Python string is made for a
word.  Texts are taken in chunks of a few MB, never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The odd base of the rolling hash over words, with its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of "anything but ASCII white space" and of "letters, digits and all beyond ASCII".
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
#: Each byte, with A-Z lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: The first 0 to 8 bytes of a number, and how many blocks of 8 bytes are mixed here before a cryptographic hash takes the rest.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_BLOCKS = 16


def _blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of bytes: its length, then each block of 8 bytes, mixed one after the other.

    Every step is a bijection of the state, so ranges of one length that differ
    in one block only never agree, and no structure of longer ones cancels out.
    """
    size = ends - starts
    blocks = _blocks(data)
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * U64(BASE) + U64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        h = mix(h ^ blocks[starts] & _HEAD[np.minimum(size, 8)])
        at, j = np.flatnonzero(size > 8), 8
        while len(at) and j < 8 * _BLOCKS:
            h[at] = mix(h[at] + U64(j) ^ blocks[starts[at] + j] & _HEAD[np.minimum(size[at] - j, 8)])
            j += 8
            at = at[size[at] > j]
        for i in at.tolist():
            rest = hashlib.blake2b(data[starts[i] + j : ends[i]].tobytes(), digest_size=8).digest()
            h[i : i + 1] = mix(h[i : i + 1] ^ U64(int.from_bytes(rest, "little")))
    return h


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the ranges of `length` bytes (over 0) at a and, in `other` or else in the same data, at b hold the same bytes."""
    other = data if other is None else other
    here, there = _blocks(data), _blocks(other)
    out = np.ones(len(a), bool)
    at, j = np.arange(len(a)), 0
    while len(at) and j < 8 * _BLOCKS:
        some = _HEAD[np.minimum(length[at] - j, 8)]
        same = here[a[at] + j] & some == there[b[at] + j] & some
        out[at[~same]] = False
        j += 8
        at = at[same & (length[at] > j)]
    for i in at.tolist():
        out[i] = data[a[i] + j : a[i] + length[i]].tobytes() == other[b[i] + j : b[i] + length[i]].tobytes()
    return out


def release() -> None:
    """Give memory that is not used back to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges of about `limit` bytes; a longer document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of some documents: byte ranges, and the first word of each document (n + 1 numbers)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.data, self.offsets = data, offsets
        is_word = word_bytes[data]
        n = len(data)
        first, last = is_word.copy(), is_word.copy()
        if n:
            first[1:] &= ~is_word[:-1]
            last[:-1] &= ~is_word[1:]
            at = offsets[(offsets > 0) & (offsets < n)]  # a word ends where its document does
            first[at] = is_word[at]
            last[at - 1] = is_word[at - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts())

    def hashes(self, fold: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if `fold`; seeds give independent ones."""
        return hash_ranges(FOLD[self.data] if fold else self.data, self.starts, self.ends, seed)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive entries; shorter by k - 1, regardless of documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= U64(BASE)
            out += hashes[j : j + n]
        return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive entries, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the given ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    at = np.cumsum(lengths) - lengths
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)
    return data[index]


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges that cover what the given ones (ordered by start) cover."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return starts[first], reach[np.concatenate((first[1:] - 1, [len(starts) - 1]))]
