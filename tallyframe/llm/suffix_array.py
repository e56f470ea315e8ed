"""Suffix-array dedup: sparse suffix arrays at minimiser positions, neighbours compared and extended to both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyframe.llm.anchors import remove_repeats
from tallyframe.llm.text import Words

PASSAGE = 50
ANCHOR_WORDS = 8


def contexts(symbol: np.ndarray, origin: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """Row i: size[i] symbols from origin[i] on, in direction step, padded with 0."""
    width = int(size.max(initial=0))
    column = np.arange(width)
    inside = column < size[:, None]
    return np.where(inside, symbol[np.where(inside, origin[:, None] + step * column, 0)] + 1, 0)


def sorted_neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and how many leading symbols each shares with the one before it in that order."""
    if not rows.shape[1]:
        return np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
    packed = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(packed.view(f"V{4 * rows.shape[1]}").ravel(), kind="stable")
    shared = np.zeros(len(rows), dtype=np.int64)
    shared[1:] = np.logical_and.accumulate(rows[order[1:]] == rows[order[:-1]], axis=1).sum(axis=1)
    return order, shared


def passage_search(length: int):
    """Sparse suffix array of a shard: its suffixes start at the anchors.

    Sorted neighbours give runs of suffixes that share r words to the right; the same over the reversed left contexts
    gives runs that share l words to the left. Windows of l + r = length words are equal exactly if both runs agree.
    """
    def search(words: Words, anchor: np.ndarray, number: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        _, symbol = np.unique(words.hashes, return_inverse=True)
        begin, size = words.bounds[:-1], np.diff(words.bounds)
        place = begin + anchor
        n = len(place)
        right_order, right_shared = sorted_neighbours(contexts(symbol, place, size - anchor, 1))
        left_order, left_shared = sorted_neighbours(contexts(symbol, place - 1, anchor, -1))
        cut = np.cumsum(number) - number
        found = np.repeat(smallest, number)
        right_run, left_run = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for left in range(length):
            window = anchor - left  # the window of a segment that starts so many words before its anchor
            have = np.flatnonzero((window >= 0) & (window < number))
            if len(have) < 2:
                continue
            right_run[right_order] = np.cumsum(right_shared < length - left)
            left_run[left_order] = np.cumsum(left_shared < left)
            key = right_run[have] * (n + 1) + left_run[have]
            order = np.lexsort((smallest[have], key))
            lead = np.concatenate(([True], np.diff(key[order]) != 0))
            least = smallest[have][order][np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            found[cut[have[order]] + window[have[order]]] = least
        return found
    return search


def passage_dedup(docs: DataFrame, length: int = PASSAGE, anchor_words: int = ANCHOR_WORDS, with_text: bool = True) -> DataFrame:
    """Removes every word of a passage of at least `length` words that also stands in a document with a smaller doc_id.

    Result and edge cases as in fm_index.substring_dedup: one row per document with doc_id, n_words, n_removed, spans,
    kept_sha256 and kept_text; null, empty and short texts lose nothing; extra columns are not read; the first document
    with a passage keeps it.
    """
    return remove_repeats(docs, length, anchor_words, passage_search(length), with_text)
