"""Spelling variants: PartEnum signatures of letter multisets, an equi-join, verification by edit distance."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.text import U64, mix, pinned, slices, span_hashes

RUN_LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
PARTS = 3  # one more than the Hamming distance: two changed elements leave a part as it is
HELD_WORDS = 250_000  # words a task counts before it hands them on
BATCH_WORDS = 4096


def run_counts(least: int, slip: int | None):
    """Partial counts of the runs of at least `least` letters. Every slip-th run of a document, by the hash of id and run,
    loses one letter first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{RUN_LETTERS}]{{{least},}}")
        held: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for rows, texts in slices(batches):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts):
                if not text:
                    continue
                key = "" if doc_id is None else str(doc_id)
                for word, n in Counter(runs.findall(text.lower().decode())).items():
                    if slip:
                        h = zlib.crc32(f"{key}:{word}".encode())
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS:
                yield handed()
        if held:
            yield handed()
    return run


def multiset_parts(letter: np.ndarray, word: np.ndarray, words: int, parts: int) -> np.ndarray:
    """A hash of each word's letter multiset in each part of the element space.

    A multiset is a binary vector with one dimension for each (letter, how many of it stand before): one inserted or
    deleted letter changes one dimension, a replaced letter two.
    """
    order = np.lexsort((letter, word))
    letter, word = letter[order], word[order]
    new = np.ones(len(letter), dtype=bool)
    new[1:] = (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])
    start = np.flatnonzero(new)
    before = np.arange(len(letter)) - np.repeat(start, np.diff(np.append(start, len(letter))))
    element = mix(letter.astype(U64) * U64(1 << 32) + before.astype(U64) + U64(1))
    out = np.zeros((words, parts), dtype=U64)
    np.add.at(out, (word, ((element >> U64(33)) % U64(parts)).astype(np.int64)), element)
    return mix(out + np.arange(1, parts + 1, dtype=U64))


def kept_spans(code: np.ndarray, first: np.ndarray, last: np.ndarray, longer: np.ndarray) -> list[np.ndarray]:
    """Hashes of what an edit leaves as it is, for a pair whose longer word has `longer` letters: the edit lies in the first,
    the middle or the last third, and the other two thirds are equal."""
    third = (longer - 1) // 3
    rest = np.minimum(longer - third, last - first)
    outer = mix(span_hashes(code, first, first + third) * U64(7) + span_hashes(code, last - third, last))
    return [outer, span_hashes(code, last - rest, last), span_hashes(code, first, first + rest)]


def signatures(parts: int):
    """(signature, up, word, n): each signature of a word for partners of its own or a smaller length, and (up) for those that are
    one letter longer. Two words at edit distance one share a signature: the larger length, the thirds that the edit leaves
    as they are, and one part of the letter multisets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_WORDS):
                batch = whole.slice(at, BATCH_WORDS)
                texts = batch.column("word").to_pylist()
                letter = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                last = np.cumsum(size)
                multiset = multiset_parts(letter, np.repeat(np.arange(len(texts)), size), len(texts), parts)
                code, keys, up = mix(letter.astype(U64) + U64(1)), [], []
                for longer in (size, size + 1):
                    for side, span in enumerate(kept_spans(code, last - size, last, longer)):
                        base = mix(span + longer.astype(U64) * U64(8) + U64(side))
                        keys += [mix(base + multiset[:, p]) for p in range(parts)]
                        up += [longer is not size] * parts
                row = pa.array(np.tile(np.arange(len(texts)), len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(up, len(texts))),
                     batch.column("word").take(row), batch.column("n").take(row)], ["signature", "up", "word", "n"])
    return run


def near_words(vocabulary: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, n_a, b, n_b: every pair of different words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    signed = vocabulary.mapInArrow(signatures(parts), "signature long, up boolean, word string, n long")
    left = signed.filter("NOT up").select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.select("signature", "up", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, (left["signature"] == right["signature"]) & (F.col("up") | (F.col("a") < F.col("b")))
                    & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a table (word, form) without circles: the end of each word's chain, by pointer doubling."""
    done = forms.select("word", F.col("form").alias("root"))
    while True:
        on = done.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = pinned(done.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return done


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, slip: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least least_length code points and seen at least
    least_count times. Two words are near if one inserted, deleted or replaced code point makes one of the other; n_near counts
    a word's near words. form is the near word with the largest n (ties: the smallest in code-point order) if its n is at least
    ratio times the word's, else null; root follows the forms to the last, and is the word itself without a form. slip: of the runs
    with crc32("<doc_id>:<run>") divisible by it, one code point is deleted first, which plants variants.

    Method: the letter multiset of a word is a binary vector, and near words are at Hamming distance two or less. PartEnum cuts
    the dimensions into three parts, of which one is equal in both (partition; nothing is left to enumerate inside a part), and
    enumerates the third of the word that holds the edit; so nine exact signatures for each length are enough for every
    pair. Words meet by an equi-join on the signature, in which levenshtein() confirms them; a frequent signature is a skewed
    join key that adaptive execution splits. Counts are combined in the tasks, so a frequent word is one row a task.

    Null, empty and letterless texts have no word. A null doc_id counts as the empty text in the hash. Repeated rows count again.
    An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select("doc_id", "text")
    counts = texts.mapInArrow(run_counts(least_length, slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = pinned(counts.filter(F.col("n") >= least_count))
    pairs = near_words(vocabulary)
    both = pinned(pairs).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    named = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    named = pinned(named)
    ends = roots(named.filter("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
