"""Words of Arrow text batches as flat numpy arrays, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows are worked on in slices of about so many bytes, whatever the batch size is. Arrays of a slice take up to a
# hundred times as much.
SLICE_BYTES = 1 << 20

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words between ASCII white space.
NOT_SPACE = ~_SPACE
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
NOT_NEWLINE = IDENTITY != 0x0A


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
    release()


def release() -> None:
    """Give freed memory back to the system. Workers outlive their tasks, next to those of other stages and to the JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the rows end to end, and where each row starts (one entry more than rows)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Words:
    """Words of some rows in order. Equal words have equal codes."""

    codes: np.ndarray
    vocabulary: pa.Array
    #: index of each row's first word; one entry more than rows
    rows: np.ndarray
    #: byte range of each word in the joined rows
    begin: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, the same in every batch and process."""
        return hash_values(self.vocabulary)[self.codes]


def split_words(
    raw: np.ndarray,
    offsets: np.ndarray,
    member: np.ndarray,
    fold: np.ndarray = IDENTITY,
    cut: np.ndarray | None = None,
) -> Words:
    """Maximal runs of ``member`` bytes in each row, with bytes replaced by ``fold``.

    ``cut`` marks bytes that start a new run also where the byte before belongs to one.
    """
    inside = member[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    if len(raw):
        after[offsets[1:] - 1] = False
    if cut is not None:
        before &= ~cut
        after[:-1] &= ~cut[1:]
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    letters = fold[raw[inside]]
    bounds = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]
    ).dictionary_encode()
    codes = np.asarray(words.indices).astype(np.int64)
    return Words(codes, words.dictionary, np.searchsorted(begin, offsets), begin, end)


def hash_values(values: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty byte strings."""
    if not len(values):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    starts = bounds[:-1] - bounds[0]
    sizes = np.diff(bounds)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    total = np.add.reduceat(_BYTE[raw] * powers[place], starts)
    return mix(total ^ sizes.astype(np.uint64))


def windows(words: Words, size: int) -> np.ndarray:
    """Index of the first word of every window of ``size`` words inside one row."""
    last = np.repeat(words.rows[1:], words.counts) - size
    return np.flatnonzero(np.arange(len(words.codes)) <= last)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each start; their order matters."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        total = mix(total * _STEP + hashes[starts + k])
    return total


def window_ranks(words: Words, starts: np.ndarray, size: int) -> np.ndarray:
    """Numbers that are equal exactly if two windows have the same words and lie in the same row.

    Built by doubling: a number for pairs, then for pairs of pairs; ``size`` is a power of two.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    wide = len(words.vocabulary)
    rank = np.unique(words.row_of * wide + words.codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < size:
        paired = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(paired, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank[starts]
