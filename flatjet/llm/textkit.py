"""Vectorised word and n-gram hashing over UTF-8 text, shared by the text operators.

Texts are handled in slices of bounded size, so memory follows the longest
single document and not the Arrow batch. Hashes are 64-bit polynomial prefix
hashes, which give the hash of any run of words from two lookups.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 17

_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words where words are letters and digits only; bytes from 0x80 up belong to words.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b & _MASK, dtype=np.uint64)
            step[0] = 1
            both.append(np.cumprod(step, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 1 << 21:
            _tables[base] = have
    return have


class Words:
    """Words of several documents.

    ``start`` and ``end`` are byte offsets into ``data``, ``doc`` is the index of
    the document of each word and ``first`` the index of each document's first
    word (one more entry than documents).
    """

    __slots__ = ("data", "doc", "end", "first", "hash", "start")

    def __init__(self, texts: list[bytes], lower: bool = False, between: np.ndarray = _SPACE):
        joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = between[joined]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.data, self.start, self.end = joined, edge[::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(joined))
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        power, inverse = _powers(_WORD_BASE, len(joined) + 1)
        terms = (_LOWER[joined] if lower else joined).astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(joined)]
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])

    def prefix(self, seed: int = 0) -> np.ndarray:
        """Prefix sums from which ``gram`` makes the hash of any run of words."""
        power, _ = _powers(_GRAM_BASE, len(self.hash) + 1)
        h = mix(self.hash ^ np.uint64(seed)) if seed else self.hash
        return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))


def gram(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [start, end)."""
    _, inverse = _powers(_GRAM_BASE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class Texts:
    """UTF-8 bytes of a string column, null as empty; made as they are asked for."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        self.size = pc.fill_null(pc.binary_length(self.column), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, part: slice) -> list[bytes]:
        lo, hi, _ = part.indices(len(self))
        return [x or b"" for x in self.column.slice(lo, hi - lo).to_pylist()]

    def __iter__(self) -> Iterator[bytes]:
        for x in self.column:
            yield x.as_py() or b""


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    return Texts(column)


def slices(texts: Texts, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that together hold ``most`` bytes or are one document."""
    begin = held = 0
    for i, size in enumerate(texts.size.tolist()):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; gives memory back at its end, as workers live on for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
                trim(0)

    return wrapped


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
