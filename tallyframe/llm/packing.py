"""Lexical retrieval packing: a sharded BM25 index, whose neighbours fill each seed document's window.

Counts of terms and the mean length are those of all documents. Documents are dealt to shards by content: of SKETCH distinct terms
weighted min-wise hashing, with the inverse document frequency as weight, draws a document's CANDIDATES, so documents share
them by about their weighted Jaccard similarity. The anchor is the candidate that fewest documents share, but COMPANY at least.
Documents sorted by anchor are cut into shards.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.text import U64, give_back, mix, pinned, process_store, slices, split_words

WINDOW = 4096
END_ID = 2
SHARD_BYTES, PARTITION_BYTES = 4 << 20, 256 << 20
SKETCH, CANDIDATES, COMPANY = 64, 8, 8
K1, B = 1.2, 0.75
SLOTS, BATCH_WORDS = 1 << 21, 10_000
# small letters as they are in every normal form, and marks after them
LETTERS_THEN_MARKS = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?*#$%&|]*)")
# how a vocabulary has to cut text for such letters to be one word of its model, spelled by bytes, and such marks words of their own
SPLIT_BY = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = {"NFC", "Lowercase", "Replace"}


class WordTokenizer:
    """Token ids of whole texts, word by word: the vocabulary drops white space, so a word's ids do not depend on others.

    Ids of words met before are found by word hash in an open-addressing table; the table starts anew when it is half full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            spec = json.load(file)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_letters = (
            {x["type"] for x in steps} <= NORMAL and all(x["pattern"] == {"Regex": "\\s+"} for x in steps if x["type"] == "Replace")
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": SPLIT_BY} and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and not any(LETTERS_THEN_MARKS.fullmatch(x["content"]) for x in spec["added_tokens"]))
        # the model's spelling of letters beyond ASCII
        self.spelling = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))
                         if self.by_letters and LETTERS_THEN_MARKS.fullmatch(c)}
        self.forget()

    def forget(self, words: int = 0) -> None:
        """An empty table with room for at least so many words."""
        self.slots = max(SLOTS, 1 << (4 * words).bit_length())
        self.keys = np.zeros(self.slots, dtype=U64)
        self.number = np.zeros(self.slots, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word; -1 if it is not there."""
        out, open_, slot = np.full(len(h), -1), np.arange(len(h)), (h & U64(self.slots - 1)).astype(np.int64)
        while len(open_):
            key = self.keys[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.number[slot[hit]]
            go = ~hit & (key != 0)
            open_, slot = open_[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def insert(self, h: np.ndarray, number: np.ndarray) -> None:
        """Different words that are not there."""
        slot = (h & U64(self.slots - 1)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = self.keys[slot] == h
            self.number[slot[mine]] = number[mine]
            h, number, slot = h[~mine], number[~mine], (slot[~mine] + 1) & (self.slots - 1)

    def learn(self, words: list[bytes]) -> None:
        """Marks at the end of a word of letters are tokens of their own, so both parts are encoded apart, and once each; letters
        go straight to the model, which is what the tokenizer does with them after cutting them out."""
        match = LETTERS_THEN_MARKS.fullmatch if self.by_letters else lambda word: None
        found = [match(w) or w for w in b"\n".join(words).decode().split("\n")] if words else []
        numbers: dict[str, int] = {}
        letters = np.array([-1 if isinstance(m, str) else numbers.setdefault(m[1], len(numbers)) for m in found], dtype=np.int64)
        model, spelling = self.tokenizer.model, self.spelling
        ids = [[t.id for t in model.tokenize(p if p.isascii() else p.translate(spelling))] for p in numbers]
        others: dict[str, int] = {}
        rest = np.array([others.setdefault(m if isinstance(m, str) else m[2], len(others)) for m in found], dtype=np.int64)
        parts = list(others)
        for a in range(0, len(parts), BATCH_WORDS):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(parts[a:a + BATCH_WORDS], add_special_tokens=False)]
        ids.append([])  # a word without such letters has -1 there
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum()))
        start = np.cumsum(size) - size
        both = np.stack((letters, rest + len(numbers)), axis=1).ravel()
        until = np.concatenate(([0], np.cumsum(size[both])))
        self.ids = np.concatenate((self.ids, flat[np.arange(until[-1]) + np.repeat(start[both] - until[:-1], size[both])]))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + until[2::2]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's."""
        # the vocabulary is lower case; only a special token's text must stay as it is
        words = split_words([t if b"<|" in t else t.lower() for t in texts])
        h = words.hashes | U64(1)  # 0 marks a free slot
        number = self.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            if len(self.bounds) + len(fresh) > self.slots // 2:
                fresh, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
                self.forget(len(fresh))
            at = new[first]
            start = len(self.bounds) - 1
            self.learn([words.raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())])
            self.insert(fresh, start + np.arange(len(fresh)))
            number = self.find(h)
        start, size = self.bounds[number], self.bounds[number + 1] - self.bounds[number]
        until = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.arange(until[-1]) + np.repeat(start - until[:-1], size)]
        return flat, until[words.bounds]


def distinct_terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and its count there, sorted by document and term; sorted as 32-bit numbers where both fit."""
    docs = len(bounds) - 1
    shift, number = (16, np.uint32) if ids.dtype.itemsize == 2 and docs <= 1 << 16 else (32, np.int64)
    pair, tf = np.unique(np.repeat(np.arange(docs).astype(number), np.diff(bounds)) << shift | ids.astype(number), return_counts=True)
    return (pair >> shift).astype(np.int64), (pair & ((1 << shift) - 1)).astype(ids.dtype), tf


@dataclass
class Statistics:
    """What the index and the anchors need of the whole corpus: one number for each entry of the vocabulary."""

    idf: np.ndarray
    race: np.ndarray  # a document's candidates are its terms of smallest race; infinite for a term of one document
    mean: float

    @classmethod
    def of(cls, df: np.ndarray, docs: int, tokens: int) -> Statistics:
        idf = np.log1p((docs - df + 0.5) / (df + 0.5))
        drawn = ((mix(np.arange(1, len(df) + 1, dtype=U64)) >> U64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
        race = np.where(df > 1, -np.log(drawn) / np.maximum(idf, 1e-12), np.inf)
        return cls(idf, race, tokens / max(docs, 1))


class BM25:
    """Inverted index over the token ids of a shard's documents; weights by the corpus' statistics where they are given."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, corpus: Statistics | None = None):
        self.docs = len(bounds) - 1
        size = np.diff(bounds)
        doc, name, tf = distinct_terms(ids, bounds)
        by_term = np.argsort(name, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(name[by_term]) != 0)[:len(name)])
        names, df = name[by_term[head]], np.diff(np.append(head, len(name)))
        term = np.empty(len(name), dtype=np.int64)
        term[by_term] = np.repeat(np.arange(len(names)), df)
        idf = corpus.idf[names] if corpus else np.log1p((self.docs - df + 0.5) / (df + 0.5))
        mean = corpus.mean if corpus else size.mean()
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1e-9)))
        several = df[term] > 1
        # of each document all terms that another document has, too; pairs are sorted by document
        self.query = term[several]
        self.query_cut = np.searchsorted(doc[several], np.arange(self.docs + 1))
        self.post, self.weight = doc[by_term], weight[by_term]
        self.post_cut = np.concatenate(([0], np.cumsum(df)))

    def neighbours(self, doc: int, used: np.ndarray) -> list[int]:
        """All unused documents by falling score over all terms; documents that share no term are left out."""
        terms = self.query[self.query_cut[doc]:self.query_cut[doc + 1]]
        if not len(terms):
            return []
        spans = [slice(self.post_cut[t], self.post_cut[t + 1]) for t in terms]
        score = np.bincount(np.concatenate([self.post[s] for s in spans]),
                            np.concatenate([self.weight[s] for s in spans]), minlength=self.docs)
        score[used] = 0
        top = np.flatnonzero(score > 0)
        return top[np.argsort(-score[top], kind="stable")].tolist()


def fill_order(index: BM25, size: np.ndarray, window: int, filled: int = 0) -> list[int]:
    """Documents in the order in which they fill windows: a seed, then its unused neighbours until the window is full or none
    with a score is left; the document that a window's end cuts is the seed of the next one. The first window holds `filled` tokens."""
    used = np.zeros(len(size), dtype=bool)
    order, queue, place, following = [], iter(()), filled, 0
    while len(order) < len(size):
        doc = next(queue, None)
        seed = doc is None
        if seed:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        order.append(doc)
        before, place = place // window, place + int(size[doc])
        if seed or place // window != before:
            queue = iter(index.neighbours(doc, used))  # none is used but from this queue until the next one
    return order


def window_cuts(total: int, window: int) -> np.ndarray:
    """Ends of the sequences: whole windows, then the rest as falling powers of two, which need no padding."""
    whole = total // window
    rest = [1 << b for b in range(window.bit_length(), -1, -1) if (total - whole * window) >> b & 1]
    return np.cumsum([window] * whole + rest)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
TOKENS = "doc_id long, ids binary, bytes long, terms binary, counts binary"


def tokenizer_of(path: str) -> WordTokenizer:
    tools = process_store().setdefault("tokenizers", {})
    if path not in tools:
        tools[path] = WordTokenizer(path)
    return tools[path]


def tokenize(path: str, vocabulary: int, kind: str):
    """A row for each document: its ids and, as terms, the SKETCH distinct ids that come first in one fixed random order. Then a
    row for each task, told by its counts: the ids of the task's documents and the number of documents that hold each."""
    order = np.argsort(mix(np.arange(vocabulary, dtype=U64) + U64(1 << 32)), kind="stable")
    place = np.argsort(order).astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, dtype=np.int64)
        for rows, texts in slices(batches, size=SHARD_BYTES >> 1):
            texts = [t or b"" for t in texts]
            ids, bounds = tokenizer_of(path).encode(texts)
            doc, at, _ = distinct_terms(place[ids], bounds)
            term = order[at]
            seen += np.bincount(term, minlength=vocabulary)
            first = np.searchsorted(doc, np.arange(len(texts)))
            last = np.minimum(np.append(first[1:], len(doc)), first + SKETCH)
            data, names = ids.astype(kind).tobytes(), term.astype(kind).tobytes()
            width = np.dtype(kind).itemsize
            cut = lambda raw, a, b: pa.array([raw[width * i:width * j] for i, j in zip(a.tolist(), b.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), cut(data, bounds[:-1], bounds[1:]), pa.array([len(t) for t in texts], pa.int64()),
                 cut(names, first, last), pa.nulls(len(texts), pa.binary())], ["doc_id", "ids", "bytes", "terms", "counts"])
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([b""], pa.binary()), pa.array([0], pa.int64()), pa.array([held.astype(kind).tobytes()], pa.binary()),
             pa.array([seen[held].tobytes()], pa.binary())], ["doc_id", "ids", "bytes", "terms", "counts"])
    return run


def term_counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), kind).astype(np.int64)),
                                                  pa.array(np.frombuffer(counts.as_py(), np.int64))], ["term", "n"])
    return run


def by_term(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """Sums by term: at most one row for each entry of the vocabulary."""
    rows = counts.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, dtype=np.int64)
    out[rows["term"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def corpus_statistics(tokens: DataFrame, vocabulary: int, kind: str, n_docs: int, n_tokens: int) -> Statistics:
    """At most one row for each entry of the vocabulary reaches the driver."""
    counts = tokens.filter("counts IS NOT NULL").select("terms", "counts").mapInArrow(term_counts(kind), "term long, n long")
    return Statistics.of(by_term(counts, vocabulary).astype(np.float64), n_docs, n_tokens)


def candidates(terms: list[bytes], race: np.ndarray, kind: str) -> np.ndarray:
    """A row of CANDIDATES for each document: its terms of smallest race that other documents hold too; -1 where there are no more."""
    width = np.dtype(kind).itemsize
    size = np.fromiter((len(t) // width for t in terms), dtype=np.int64, count=len(terms))
    flat = np.frombuffer(b"".join(terms), kind).astype(np.int64)
    order = np.lexsort((flat, race[flat], np.repeat(np.arange(len(terms)), size)))
    flat = np.append(np.where(np.isfinite(race[flat]), flat, -1)[order], -1)
    at = (np.cumsum(size) - size)[:, None] + np.arange(CANDIDATES)
    return np.where(np.arange(CANDIDATES) < size[:, None], flat[np.minimum(at, len(flat) - 1)], -1)


def count_candidates(race: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(race), dtype=np.int64)
        for batch in batches:
            found = candidates(batch.column("terms").to_pylist(), race, kind)
            n += np.bincount(found[found >= 0], minlength=len(race))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["term", "n"])
    return run


def best_two(found: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """Of each row's candidates the two that fewest documents have as candidates, but at least COMPANY; with none, those that most have."""
    rank = np.append(np.where(followers >= COMPANY, followers, (1 << 62) - followers), 1 << 62)  # the last is that of -1
    return np.take_along_axis(found, np.argsort(rank[found], axis=1, kind="stable")[:, :2], axis=1)


def give_anchors(race: np.ndarray, followers: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = best_two(candidates(batch.column("terms").to_pylist(), race, kind), followers)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()),
                                              *[batch.column(n) for n in ("row", "doc_id", "ids", "bytes")]],
                                             ["anchor", "second", "row", "doc_id", "ids", "bytes"])
    return run


def deal(tokens: DataFrame, corpus: Statistics, kind: str, partitions: int) -> DataFrame:
    """Documents in ranges of their anchors, sorted inside. The row's number ends the key, so a hot anchor is spread over ranges."""
    rows = tokens.filter("counts IS NULL").select("terms", "row", "doc_id", "ids", "bytes")
    followers = by_term(rows.select("terms").mapInArrow(count_candidates(corpus.race, kind), "term long, n long"), len(corpus.race))
    anchored = rows.mapInArrow(give_anchors(corpus.race, followers, kind), "anchor long, second long, row long, doc_id long, ids binary, bytes long")
    return anchored.repartitionByRange(partitions, "anchor", "second", "row").sortWithinPartitions("anchor", "second", "row")


def shards_of(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """Sorted documents in runs of about shard_bytes of text; a document counts as 8 bytes more."""
    held, size = [], 0
    for batch in batches:
        run = np.cumsum(np.asarray(batch.column("bytes")) + 8)
        start = 0
        while start < batch.num_rows:
            until = int(np.searchsorted(run, shard_bytes - size + (run[start - 1] if start else 0))) + 1
            part = batch.slice(start, min(until, batch.num_rows) - start)
            held.append(part)
            size += int(run[start + part.num_rows - 1] - (run[start - 1] if start else 0))
            start += part.num_rows
            if size >= shard_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Pieces:
    """Parts of documents that follow each other in a stream of tokens."""

    doc_id: pa.Array
    start: np.ndarray
    size: np.ndarray
    doc_tokens: np.ndarray
    stream: np.ndarray

    def after(self, other: Pieces | None) -> Pieces:
        if other is None:
            return self
        return Pieces(pa.concat_arrays([other.doc_id, self.doc_id]), *[
            np.concatenate((getattr(other, n), getattr(self, n))) for n in ("start", "size", "doc_tokens", "stream")])

    def cut(self, cuts: np.ndarray, sequence: int) -> tuple[pa.RecordBatch, Pieces | None]:
        """The sequences that end at cuts, the first under this number, and what comes after the last one."""
        piece_end = np.cumsum(self.size)
        end = np.union1d(piece_end, cuts)
        begin = np.concatenate(([0], end[:-1]))
        piece, number = np.searchsorted(piece_end, begin, side="right"), np.searchsorted(cuts, begin, side="right")
        start = self.start[piece] + begin - (piece_end - self.size)[piece]
        done = int(np.searchsorted(number, len(cuts)))  # pieces from here on are in no sequence yet
        data = self.stream.tobytes()
        out = pa.RecordBatch.from_arrays(
            [self.doc_id.take(pa.array(piece[:done])), pa.array(start[:done]), pa.array((end - begin)[:done]),
             pa.array([data[4 * a:4 * b] for a, b in zip(begin[:done].tolist(), end[:done].tolist())], pa.binary()),
             pa.array(self.doc_tokens[piece[:done]]), pa.array(sequence + number[:done]),
             pa.array((begin - np.concatenate(([0], cuts))[number])[:done])],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        if done == len(begin):
            return out, None
        return out, Pieces(self.doc_id.take(pa.array(piece[done:])), start[done:], (end - begin)[done:], self.doc_tokens[piece[done:]],
                           self.stream[begin[done]:].copy())


def pack_range(corpus: Statistics, kind: str, window: int, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rest = TaskContext.get().partitionId() << 40, None
        for shard in shards_of(batches, shard_bytes):
            parts = [np.frombuffer(t, kind) for t in shard.column("ids").to_pylist()]
            size = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
            bounds = np.concatenate(([0], np.cumsum(size)))
            ids = np.concatenate(parts)
            filled = len(rest.stream) if rest else 0
            order = np.array(fill_order(BM25(ids, bounds, corpus), size + 1, window, filled))
            stream = np.concatenate([x for d in order.tolist() for x in (parts[d], [end_id])]).astype("<u4")
            size = (size + 1)[order]
            doc_id = shard.column("doc_id").combine_chunks().take(pa.array(order))
            pieces = Pieces(doc_id, np.zeros(len(order), dtype=np.int64), size, size, stream).after(rest)
            whole = np.arange(window, len(pieces.stream) + 1, window)
            out, rest = pieces.cut(whole, sequence)
            sequence += len(whole)
            yield out
            give_back()
        if rest:
            yield rest.cut(window_cuts(len(rest.stream), window), sequence)[0]
    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, start, length, ids (little-endian unsigned
    32-bit, as binary), doc_tokens, sequence_id, offset.

    Documents are tokenized once and checkpointed as ids. Their terms are counted over the whole corpus, which gives each
    document an anchor; documents sorted by anchor lie in ranges, and a task reads its range as a stream of shards of about
    shard_bytes of text: one shard at a time is indexed and packed. Tokens that do not fill a window go on to the next shard;
    those left at the end of a range form sequences of powers of two, so nothing is padded. A document longer than the window
    goes on in the next sequences. window must be a power of two.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. An empty table gives an empty
    result. Extra columns are not read. A null doc_id stays null.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    vocabulary = tokenizer_of(tokenizer_path).tokenizer.get_vocab_size()
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = pinned(rows.mapInArrow(tokenize(tokenizer_path, vocabulary, kind), TOKENS).withColumn("row", F.monotonically_increasing_id()))
    size = tokens.filter("counts IS NULL").agg(F.sum("bytes").alias("b"), F.sum(F.octet_length("ids")).alias("i"), F.count("*").alias("n")).first()
    corpus = corpus_statistics(tokens, vocabulary, kind, size["n"], (size["i"] or 0) // np.dtype(kind).itemsize)
    total = (size["b"] or 0) + 8 * size["n"]
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(total // shard_bytes + 1, max(usual, total // PARTITION_BYTES + 1))
    return deal(tokens, corpus, kind, partitions).mapInArrow(pack_range(corpus, kind, window, end_id, shard_bytes), SCHEMA)
