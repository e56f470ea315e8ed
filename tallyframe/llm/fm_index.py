"""Substring dedup: a compressed FM-index per shard, searched backwards over a wavelet matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyframe.llm.anchors import remove_repeats
from tallyframe.llm.text import U64, Words

WINDOW = 13
ANCHOR_WORDS = 4


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector per level, with a count before each 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels):
            bit = ((current >> (self.levels - 1 - level)) & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view(U64)
            self.bits.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[~bit], current[bit]))
        self.base = self.descend(np.arange(size), np.zeros(size, dtype=np.int64))

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word = place >> 6
            ones = self.before[level][word] + np.bitwise_count(
                self.bits[level][word] & ((U64(1) << (place & 63).astype(U64)) - U64(1)))
            high = (symbol >> (self.levels - 1 - level)) & 1
            place = np.where(high, self.zeros[level] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.descend(symbol, place) - self.base[symbol]


def suffix_order(text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes sorted by prefix doubling; every end mark (0) is a smallest symbol of its own, in order of place."""
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    reach = 1
    order = np.argsort(rank, kind="stable")
    while reach < longest + 1:
        # a suffix that ends within reach is told apart by its end mark already
        follow = np.zeros_like(rank)
        follow[:-reach or None] = rank[reach:]
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key)
        step = np.concatenate(([0], np.diff(key[order]) != 0))
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        reach *= 2
    return order


class FMIndex:
    """Texts (arrays of symbols from 1) with an end mark each."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, longest: int):
        self.order = suffix_order(text, ends, longest)
        size = int(text.max(initial=0)) + 1
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.tree = WaveletMatrix(text[self.order - 1], size)

    def first(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.smaller[symbol], self.smaller[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes start with symbol and go on as low:high."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.smaller[symbol] + both[:len(symbol)], self.smaller[symbol] + both[len(symbol):]


def window_search(length: int):
    """Streams the windows of a shard's segments backwards through its FM-index.

    The width of a window's interval says in how many segments it occurs. A window stops as soon as only itself is left
    (its match is shorter than the threshold); those that reach the full length take the smallest id of their interval.
    """
    def search(words: Words, anchor: np.ndarray, number: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        values, symbol = np.unique(words.hashes, return_inverse=True)
        sizes = np.diff(words.bounds)
        text = np.zeros(len(symbol) + len(sizes), dtype=np.int64)
        places = np.arange(len(symbol)) + words.doc
        text[places] = symbol + 1
        ends = np.cumsum(sizes + 1) - 1
        index = FMIndex(text, ends, int(sizes.max()))
        own = np.repeat(np.arange(len(number)), number)
        start = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number) + (ends - sizes)[own]
        found = smallest[own]
        active = np.arange(len(own))
        low, high = index.first(text[start + length - 1])
        for step in range(1, length):
            more = high - low > 1
            active, low, high = active[more], low[more], high[more]
            if not len(active):
                return found
            low, high = index.extend(text[start[active] + length - 1 - step], low, high)
        more = high - low > 1
        active, low, high = active[more], low[more], high[more]
        if len(active):
            segment_of = np.repeat(np.arange(len(sizes)), sizes + 1)
            ids = np.append(smallest[segment_of[index.order]], np.iinfo(np.int64).max)
            lows, first, back = np.unique(low, return_index=True, return_inverse=True)  # intervals of one length: disjoint
            cuts = np.stack((lows, high[first]), axis=1).ravel()
            found[active] = np.minimum.reduceat(ids, cuts)[::2][back]
        return found
    return search


def substring_dedup(docs: DataFrame, length: int = WINDOW, anchor_words: int = ANCHOR_WORDS, with_text: bool = True) -> DataFrame:
    """Removes every word covered by a window of `length` words that also starts in a document with a smaller doc_id.

    Shards hold whole anchors (see anchors.py), so that each window is searched in exactly one of them: an FM-index over
    the shard's different segments, the segments themselves streamed through it. Result: one row per document with
    doc_id, n_words, n_removed, spans (removed word ranges), kept_sha256 and kept_text (words joined by one blank; a text
    that loses nothing is unchanged).

    A null or empty text has no words and keeps nothing (sha of the empty string; kept_text as given). Repeats within a
    document are left alone. Texts shorter than the window are left alone. Other columns, whatever their names, are not
    read. An empty table gives an empty result. Rows with one doc_id and different texts are documents of their own; rows with a null doc_id keep their text.
    """
    return remove_repeats(docs, length, anchor_words, window_search(length), with_text)
