"""Words of two or more characters and their bigrams, counted in numpy from Arrow lists of words.

No Python object is made for a word of a text, only for the different words of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are worked on at once; a row with more is worked on alone.
SLICE_WORDS = 1 << 17
#: Slices that are added to the places together, and pairs of words that are sorted together.
SLICES_ADDED = 16
PAIRS_SORTED = 1 << 20
#: Entries of rows that are worked on at once.
SLICE_ENTRIES = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xBF58476D1CE4E5B9)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    """Freed memory goes back to the system, not to be held by each worker until its end."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` in all; a longer row is a range of its own."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first = last


def list_lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the number of each word among them, and the words of each row."""
    coded = lists.flatten().cast(pa.string()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), list_lengths(lists)


def _word_slices(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, words, row of each word from the first on, and whether the next word is in the same row."""
    at = 0
    for first, last in slices(lengths, SLICE_WORDS):
        row = np.repeat(np.arange(last - first), lengths[first:last])
        yield first, codes[at : at + len(row)], row, row[1:] == row[:-1]
        at += len(row)


def _hashes(words: pa.Array) -> np.ndarray:
    found = np.fromiter(map(crc32, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    return (found + np.uint64(1)) * _MORE


def _place(hashes: np.ndarray, places: int) -> np.ndarray:
    mixed = hashes * _ODD
    mixed >>= np.uint64(32)
    mixed *= np.uint64(places)
    mixed >>= np.uint64(32)
    return mixed.view(np.int64)


def _pair_places(hashes: np.ndarray, words: np.ndarray, joined: np.ndarray, places: int) -> np.ndarray:
    """Place of each word with the next one, ``places`` where that is in another row."""
    seen = hashes.take(words)
    pairs = seen[:-1] >> np.uint64(9)
    pairs ^= seen[1:]
    found = _place(pairs, places)
    found[~joined] = places
    return found


def place_counts(places: int) -> Callable:
    """``_place, _n`` of a task: occurrences of words and bigrams in places that their hashes choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = np.zeros(places + 1, np.int64), []

        def add() -> None:
            nonlocal total
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=places + 1)
            waiting.clear()

        for batch in batches:
            words, codes, lengths = _coded(batch.column(0))
            hashes = _hashes(words)
            total += np.bincount(_place(hashes, places), np.bincount(codes, minlength=len(words)), places + 1).astype(np.int64)
            for _, some, _, joined in _word_slices(codes, lengths):
                waiting.append(_pair_places(hashes, some, joined, places))
                if len(waiting) == SLICES_ADDED:
                    add()
            add()
            del words, codes, lengths, hashes, batch
            release()
        seen = np.flatnonzero(total[:places])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["_place", "_n"])

    return run


def term_counts(chosen: np.ndarray) -> Callable:
    """``term, _n`` of the words and bigrams of the chosen places, several rows for a term."""
    places = len(chosen)

    def counted(words: pa.Array, pairs: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        one, two = (words.take(pa.array(p)) for p in np.divmod(pair, len(words)))
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(one, two, " "), pa.array(n)], ["term", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.append(chosen, False)
        for batch in batches:
            words, codes, lengths = _coded(batch.column(0))
            if not len(words):
                continue
            hashes, pairs, waiting = _hashes(words), [], 0
            own = np.flatnonzero(held[_place(hashes, places)])
            yield pa.RecordBatch.from_arrays([words.take(pa.array(own)), pa.array(np.bincount(codes, minlength=len(words))[own])], ["term", "_n"])
            for _, some, _, joined in _word_slices(codes, lengths):
                at = np.flatnonzero(held[_pair_places(hashes, some, joined, places)])
                pairs.append(some[at].astype(np.int64) * len(words) + some[at + 1])
                waiting += len(at)
                if waiting >= PAIRS_SORTED:
                    yield counted(words, pairs)
                    pairs, waiting = [], 0
            if waiting:
                yield counted(words, pairs)
            del words, codes, lengths, hashes, pairs, batch
            release()

    return run


class TermCounter:
    """Counts of listed words and bigrams in each row."""

    FILTER_BITS = 18

    def __init__(self, terms: list[str]):
        parts = [t.split(" ") for t in terms]
        words = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(words)}
        self.words, self.many, self.size = pa.array(words, pa.string()), max(1, len(words)), max(1, len(terms))
        # the last place is that of other words
        self.single = np.full(len(words) + 1, -1, np.int64)
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = i
            elif len(p) == 2:
                pairs.append((number[p[0]] * self.many + number[p[1]], i))
        self.pairs, self.pair_terms = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()
        self.possible = np.zeros(1 << self.FILTER_BITS, bool)
        self.possible[self._slot(self.pairs)] = True

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _ODD) >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)

    def count(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of each row, and their terms and counts, by row and term."""
        words, codes, lengths = _coded(lists)
        known = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        entries, terms, counts = np.zeros(len(lengths), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, some, row, joined in _word_slices(codes, lengths):
            word = known[some]
            alone = self.single[word]
            hit = alone >= 0
            keys = [row[hit] * self.size + alone[hit]]
            if len(self.pairs):
                at = np.flatnonzero(joined & (word[:-1] >= 0) & (word[1:] >= 0))
                pair = word[at] * self.many + word[at + 1]
                maybe = self.possible[self._slot(pair)]
                at, pair = at[maybe], pair[maybe]
                place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                found = self.pairs[place] == pair
                keys.append(row[at[found]] * self.size + self.pair_terms[place[found]])
            key = np.sort(np.concatenate(keys))
            begins = np.flatnonzero(np.diff(key, prepend=-1))
            key, n = key[begins], np.diff(begins, append=len(key))
            own = np.bincount(key // self.size, minlength=row[-1] + 1 if len(row) else 0)
            entries[first : first + len(own)] = own
            terms.append(key % self.size)
            counts.append(n)
        return entries, np.concatenate(terms), np.concatenate(counts)

    def lists(self, lists: pa.Array) -> pa.Array:
        """``count`` as an Arrow array of ``array<struct<i:int,tf:double>>``."""
        entries, terms, counts = self.count(lists)
        offsets = pa.array(np.concatenate([[0], np.cumsum(entries)]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.int32()), pa.array(counts.astype(np.float64))], ["i", "tf"])
        release()
        return pa.ListArray.from_arrays(offsets, pairs)


def unit_weights(lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and weight of each entry, sublinear tf times idf with unit length per row; the length of each row before."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    raw = (1.0 + np.log(counts)) * idf[terms]
    norm = np.sqrt(np.bincount(row, raw * raw, minlength=len(lengths)))
    return row, raw / norm[row], norm
