"""Scores of texts by a subword lattice: the probability of a word sums over all its segmentations into vocabulary pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.anchors import packed_column, unpacked
from tallyframe.llm.text import BASE, BASE_INVERSE, U64, Words, give_back, id_remainder, powers, slices, small_batches, split_words

HOLD_OUT = 10
BLOCK_BYTES = 24 << 20
LEARN_BYTES = 2 << 20  # of text, worked on at once; the next ones are of compressed text
COUNT_BYTES, SCORE_BYTES = 3 << 20, 2 << 20
MAIN_CLASSES = 15
PRIOR_MASS = 200.0  # of the vocabulary's own scores, against one for each word type met
BORROWED = 0.02  # weight of the counts of all languages beside those of one
BATCH = 5_000
MOST_UNKNOWN = 0.5
SPREAD = U64(0x9FB21C651E98DF25)
SCREEN_BITS = 18


@dataclass
class Pieces:
    """Arcs of the lattice: pieces that start a word, pieces that go on, and single bytes for both. prior: by own scores."""

    tables: list  # for start and going on: marks of the slots that some key has, [(keys by slot, piece numbers by slot, bits of a slot), ...]
    first: int  # number of arcs that start a word; they come first
    prior: np.ndarray
    longest: int  # bytes of the longest piece
    lengths: np.ndarray  # bit n % 64: some piece of n bytes has these first three bytes, or others of the same slot

    @staticmethod
    def load(path: str) -> Pieces:
        """Takes the scores of a vocabulary file as weights; a score of -r, as rank-scored files have it, weighs 1 / (1 + r)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        start, onward = {}, {}
        for i in range(model.vocab_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
                continue
            piece, weight = model.id_to_piece(i), 1.0 / (1.0 + max(0.0, -model.get_score(i)))
            body = piece.removeprefix("▁")
            data = body.encode()
            if body and "▁" not in body:
                (start if body != piece else onward)[data] = weight
        least = 1.0 / (1.0 + model.vocab_size())
        weights, keys, places = [], [], []
        for table in (start, onward):
            at = len(keys)
            keys += [piece_key(p) for p in table]
            weights += [*table.values(), *[least] * 256]
            places.append(np.arange(at, len(keys)))
            keys += [0] * 256  # the single bytes are not looked up
        keys = np.array(keys, dtype=U64)
        first = len(start) + 256
        prior = np.array(weights)
        prior[:first] /= prior[:first].sum()
        prior[first:] /= prior[first:].sum()
        lengths = np.zeros(1 << 18, dtype=U64)
        for p in (*start, *onward):
            if len(p) > 2:
                slot = three_bytes(*np.frombuffer(p, dtype=np.uint8)[:3].astype(np.int64))
                lengths[slot] |= U64(1 << len(p) % 64)
        return Pieces([hash_tables(keys, p) for p in places], first, prior, max((len(p) for p in (*start, *onward)), default=1), lengths)

    def find(self, onward: int, key: np.ndarray) -> np.ndarray:
        """Numbers of the arcs with these keys; -1 for none."""
        out = np.full(key.size, -1, dtype=np.int64)
        flat = key.ravel() * SPREAD  # odd, so that it tells keys apart as they do themselves
        screen, tables = self.tables[onward]
        open_ = np.flatnonzero(screen.take((flat >> U64(64 - SCREEN_BITS)).view(np.int64)))  # most substrings are no piece
        flat = flat[open_]
        for known, numbers, bits in tables:
            slot = (flat >> U64(64 - bits)).view(np.int64)
            hit = known.take(slot) == flat
            out[open_[hit]] = numbers[slot[hit]]
            open_, flat = open_[~hit], flat[~hit]
        return out.reshape(key.shape)

    def byte(self, onward: int) -> int:
        """Number of the first single-byte arc."""
        return len(self.prior) - 256 if onward else self.first - 256


def substring_key(value: np.ndarray, length: int) -> np.ndarray:
    """Key of substrings from their polynomial value; never 0, which marks a free slot."""
    return (value + U64(length)) * SPREAD | U64(1)


def piece_key(piece: bytes) -> int:
    value = (np.frombuffer(piece, dtype=np.uint8).astype(U64) + U64(1)) * powers(BASE, len(piece))
    return int(substring_key(value.sum(dtype=U64, keepdims=True), len(piece))[0])


def three_bytes(one, two, three):
    """A slot out of 2^18, of its own for three small letters."""
    return (one ^ two << 5 ^ three << 10) & ((1 << 18) - 1)


def hash_tables(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list]:
    """A direct table by some bits of the spread key; what collides goes to a smaller one, and so on. Before them a screen of more bits."""
    out, bits, keys = [], 16, keys * SPREAD
    screen = np.zeros(1 << SCREEN_BITS, dtype=bool)
    screen[keys[places] >> U64(64 - SCREEN_BITS)] = True
    while len(places):
        slot = keys[places] >> U64(64 - bits)
        known, numbers = np.zeros(1 << bits, dtype=U64), np.zeros(1 << bits, dtype=np.int64)
        known[slot], numbers[slot] = keys[places], places
        out.append((known, numbers, bits))
        places = places[numbers[slot] != places]
        bits = max(bits - 1, 1) if len(out) < 12 else bits + 3
    return screen, out


def found_arcs(pieces: Pieces, letters: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, arc numbers) over words of one length, given as a matrix of bytes; a place is start * words + word.

    The first entry has the single bytes, one for every place; the others only the places where a piece of that length stands, in order.
    """
    words, size = letters.shape
    codes = letters.T.astype(np.int64)
    sums = np.zeros((size + 1, words), dtype=U64)
    np.cumsum((codes.view(U64) + U64(1)) * powers(BASE, size)[:, None], axis=0, out=sums[1:], dtype=U64)
    sums, back = sums.ravel(), powers(BASE_INVERSE, size + 1)
    whole = codes + pieces.byte(1)
    whole[0] += pieces.byte(0) - pieces.byte(1)
    out = [(1, np.arange(words * size), whole.ravel())]
    lengths = pieces.lengths.take(three_bytes(codes[:-2], codes[1:-1], codes[2:])).ravel() if size > 2 else None
    for n in range(1, min(pieces.longest, size) + 1):
        wide = (size + 1 - n) * words  # only places where some piece is so long are looked up
        at = np.arange(wide) if n < 3 else np.flatnonzero(lengths[:wide] & U64(1 << n % 64))
        key = substring_key((sums.take(at + n * words) - sums.take(at)) * back.take(at // words), n)
        lead = int(np.searchsorted(at, words))
        found = np.concatenate((pieces.find(0, key[:lead]), pieces.find(1, key[lead:])))
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            out.append((n, at[hit], found[hit]))
    return out


def arcs_of(pieces: Pieces, letters: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The arcs as (length, arc numbers by word and start); -1: no arc."""
    words, size = letters.shape
    out = []
    for n, at, found in found_arcs(pieces, letters):
        number = np.full((size + 1 - n) * words, -1, dtype=np.int64)
        number[at] = found
        out.append((n, number.reshape(-1, words).T))
    return out


def by_start(arcs: list, words: int, size: int) -> list[tuple[int, list]]:
    """(length, [(words, arc numbers) for each start]) of the arcs after the single bytes."""
    out = []
    for n, at, number in arcs[1:]:
        cuts = np.searchsorted(at, np.arange(size + 2 - n) * words).tolist()
        out.append((n, [(at[a:b] - start * words, number[a:b]) for start, (a, b) in enumerate(zip(cuts, cuts[1:]))]))
    return out


def log_add(total: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], far: bool) -> np.ndarray:
    """log of exp(total) and the exp(part) of each (words, part). far: a part may exceed total by more than a float's exponent holds."""
    if not parts:
        return total
    top = total
    if far:
        top = total.copy()
        for hit, part in parts:
            top[hit] = np.maximum(top.take(hit, axis=0), part)
    more = np.exp(total - top) if far else np.ones_like(total)
    for hit, part in parts:
        more[hit] += np.exp(part - top.take(hit, axis=0))
    return top + np.log(more)


def far_apart(pieces: Pieces, table: np.ndarray) -> bool:
    """Whether the bytes of a piece, one by one, may weigh less than the piece by more than a float's exponent holds."""
    least = min(table[pieces.byte(k):pieces.byte(k) + 256].min() for k in (0, 1))
    return bool(-least * pieces.longest > 600)


def forward(arcs: list, starts: list, table: np.ndarray, words: int, size: int, far: bool) -> np.ndarray:
    """Log-space forward recursion: row e sums all ways to spell the first e bytes. table: log weights of each arc, of one class or several.

    It runs over the arcs that are there; a single byte is one, so no place is without.
    """
    alpha = np.zeros((size + 1, words, *table.shape[1:]))
    whole = arcs[0][2].reshape(size, words)
    for end in range(1, size + 1):
        parts = [(hit, alpha[end - n].take(hit, axis=0) + table.take(number, axis=0))
                 for n, at in starts if n <= end for hit, number in (at[end - n],) if len(hit)]
        alpha[end] = log_add(alpha[end - 1] + table.take(whole[end - 1], axis=0), parts, far)
    return alpha


def by_length(words: Words, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members of pick, their bytes) for groups of one length and a bounded size."""
    raw = np.frombuffer(words.raw, dtype=np.uint8)
    size = (words.ends - words.starts)[pick]
    order = np.argsort(size, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]))
    for a, b in zip(cut[:-1], cut[1:]):
        n = int(size[order[a]]) if b > a else 0
        step = max(1, BATCH * 8 // max(n, 8))
        for c in range(a, b, step):
            group = order[c:min(c + step, b)]
            yield group, raw[words.starts[pick[group]][:, None] + np.arange(n)]


def expected_uses(pieces: Pieces, weight: np.ndarray, words: Words, pick: np.ndarray, member: np.ndarray | None = None) -> np.ndarray:
    """Expected number of uses of each arc over all segmentations of the picked words (forward and backward recursion).

    member: which of several classes (column) each picked word (row) belongs to; then a row of uses for each class.
    """
    out = np.zeros((1 if member is None else member.shape[1], len(pieces.prior)))
    far = far_apart(pieces, weight)
    for group, letters in by_length(words, pick):
        arcs, (count, size) = found_arcs(pieces, letters), letters.shape
        starts = by_start(arcs, count, size)
        alpha = forward(arcs, starts, weight, count, size, far)
        beta, whole = np.zeros_like(alpha), arcs[0][2].reshape(size, count)
        for start in range(size - 1, -1, -1):
            parts = [(hit, beta[start + n].take(hit) + weight.take(number))
                     for n, at in starts if start + n <= size for hit, number in (at[start],) if len(hit)]
            beta[start] = log_add(beta[start + 1] + weight.take(whole[start]), parts, far)
        before, after = (alpha - alpha[size]).ravel(), beta.ravel()
        number = np.concatenate([x for _, _, x in arcs])
        chance = np.exp(np.concatenate([before.take(at) + after.take(at + n * count) for n, at, _ in arcs]) + weight.take(number))
        if member is None:
            out[0] += np.bincount(number, chance, minlength=out.shape[1])
            continue
        word = np.concatenate([at % count for _, at, _ in arcs])
        for k, mine in enumerate(member[group].T):
            if mine.any():
                hit = slice(None) if mine.all() else np.flatnonzero(mine.take(word))
                out[k] += np.bincount(number[hit], chance[hit], minlength=out.shape[1])
    return out[0] if member is None else out


def spelled(pieces: Pieces, weights: list[tuple[np.ndarray, float]], words: Words, pick: np.ndarray) -> np.ndarray:
    """Log10 of the marginal probability of each picked word (row) under each class's weights (column)."""
    out = np.zeros((len(pick), len(weights)))
    table = np.stack([weight for weight, _ in weights], axis=1)
    stop = np.array([last for _, last in weights])
    far = far_apart(pieces, table)
    for group, letters in by_length(words, pick):
        arcs, (count, size) = found_arcs(pieces, letters), letters.shape
        out[group] = (forward(arcs, by_start(arcs, count, size), table, count, size, far)[size] + stop) / np.log(10)
    return out


def arc_weights(pieces: Pieces, uses: np.ndarray, types: float) -> tuple[np.ndarray, float]:
    """Log weights (-inf last) and the log chance that a word ends, from expected uses and the vocabulary's own scores."""
    first = pieces.first
    mass = uses + PRIOR_MASS * pieces.prior
    stop = (types + PRIOR_MASS) / mass.sum()
    stop = min(max(stop, 0.05), 0.95)
    weight = np.concatenate((mass[:first] / mass[:first].sum(), (1 - stop) * mass[first:] / mass[first:].sum()))
    return np.append(np.log(weight), -np.inf), float(np.log(stop))


@dataclass
class Model:
    """What the blocks need: classes with documents, tokens and arc weights, numbers of words; the counts of words come by shuffle."""

    pieces: Pieces
    docs: np.ndarray
    tokens: np.ndarray
    weights: list[tuple[np.ndarray, float]]
    types: int  # different words of the training documents
    once: int  # those that occur once


TYPES, DOCS, TOKENS, ONCE = -1, -2, -3, -4


def class_counts(of: np.ndarray, kind: np.ndarray, size: int, classes: list[int]) -> list[np.ndarray]:
    """For each of the classes how often each of `size` words occurs; of, kind: word and class of each occurrence."""
    return [np.bincount(of[kind == k], minlength=size) for k in classes]


def training_words(classes: int):
    """word, c0, c1, ...: a slice's different words with their numbers in each class; one row without a word has those of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, size=LEARN_BYTES):
            kind = np.asarray(rows.column("class"))
            words = split_words([t.lower() if t and k >= 0 else None for t, k in zip(texts, kind.tolist())])
            _, at, of = np.unique(words.hashes, return_index=True, return_inverse=True)
            counts = class_counts(of, kind[words.doc], len(at), list(range(classes)))
            edges = np.stack([words.starts, words.ends], axis=1).ravel().astype(np.int32)  # words and the gaps between them
            spans = pa.Array.from_buffers(pa.binary(), max(len(edges) - 1, 0), [None, pa.py_buffer(edges), pa.py_buffer(words.raw)])
            names = pa.concat_arrays([pa.array([None], pa.binary()), spans.take(pa.array(2 * at))])
            yield pa.RecordBatch.from_arrays([names, *(pa.array(np.append(int((kind == k).sum()), c)) for k, c in enumerate(counts))],
                                             ["word", *(f"c{k}" for k in range(classes))])
    return run


def training_sums(pieces: Pieces, classes: int):
    """Per class: expected arc uses over the words of the rows, numbers of types, documents and tokens. Class `classes` is all together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.append(np.log(pieces.prior), -np.inf)
        uses, sums = np.zeros((classes, len(pieces.prior))), np.zeros((classes + 1, 4))
        for rows, texts in slices(batches, "word"):
            words = split_words(texts)  # the row without a word has none
            counts = np.stack([np.asarray(rows.column(f"c{k}")) for k in range(classes)], axis=1)
            docs = counts[[t is None for t in texts]].sum(axis=0)
            member = counts[words.doc] > 0
            uses += expected_uses(pieces, weight, words, np.arange(len(words.starts)), member)
            sums[:classes, :3] += np.stack([member.sum(axis=0), docs, counts.sum(axis=0)], axis=1)
            sums[classes, [-TYPES - 1, -ONCE - 1]] += len(member), (counts[words.doc].sum(axis=1) == 1).sum()
        rows = [(k, -i - 1, v) for k, own in enumerate(sums.tolist()) for i, v in enumerate(own)]
        rows += [(k, int(i), float(v[i])) for k, v in enumerate(uses) for i in np.flatnonzero(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.float64())], ["class", "arc", "value"])
    return run


def block_words(classes: list[int]):
    """block, word hash, counts by class: each block's words, once, with their numbers in these classes, 0 where only others have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for rows, texts in unpacked(batches, COUNT_BYTES):
            words = split_words([t.lower() if t else t for t in texts])
            block, kind = np.asarray(rows.column("block")), np.asarray(rows.column("class"))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]  # sorted by block
            for a, b in zip(cuts, cuts[1:]):
                if parts and block[a] != now:
                    yield block_rows(now, parts, classes)
                    parts = []
                now, mine = int(block[a]), slice(words.bounds[a], words.bounds[b])
                h, of = np.unique(words.hashes[mine], return_inverse=True)
                parts.append((h, class_counts(of, kind[words.doc[mine]], len(h), classes)))
                if len(parts) > 1:  # no more than the block's different words are kept
                    parts = [added(parts)]
        if parts:
            yield block_rows(now, parts, classes)
    return run


def added(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different words of all parts, in order, with the sums of their counts."""
    h = np.concatenate([h for h, _ in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[at], [np.add.reduceat(np.concatenate(c)[order], at) if len(at) else c[0] for c in zip(*(c for _, c in parts))]


def block_rows(block: int, parts: list, classes: list[int]) -> pa.RecordBatch:
    h, counts = parts[0]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block, dtype=np.int32)), pa.array(h.view(np.int64)), *map(pa.array, counts)],
                                      ["block", "word", *(f"c{k}" for k in classes)])


def block_scores(model: Model, live: list[int]):
    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        known = np.asarray(table.column("word")).view(U64)
        order = np.argsort(known)
        known, per_class = known[order], np.stack([np.asarray(table.column(f"c{k}"))[order] for k in live], axis=1)
        total = per_class.sum(axis=1)
        del table, order
        n, ends = int(model.tokens.sum()), int(model.docs.sum())
        types = model.types + int(ends > 0)  # the end is a type
        novel = min(max(model.once / n if n else 1.0, 1e-4), MOST_UNKNOWN) if n else 1.0
        own, all_ = (1 - novel) * (1 - BORROWED), (1 - novel) * BORROWED
        share = np.log10(model.docs[live] / ends) if n else np.zeros(1)
        base_of = n + 0.1 * (types + 1)
        over = model.docs[live] / (model.tokens[live] + 1) if n else np.zeros(1)  # chance of the end, by the lattice alone
        stop, go = (np.log10(over), np.log10(1 - over)) if n else (np.zeros(1), np.zeros(1))
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "lattice_score")}
        done, done_logs = np.zeros(0, dtype=U64), np.zeros((0, len(live)))
        for batch in docs.to_batches():
            for rows, texts in unpacked(iter([batch]), SCORE_BYTES):
                words = split_words([t.lower() if t else t for t in texts])
                h, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                met = known[place] == h if len(known) else np.zeros(len(h), dtype=bool)
                count = np.where(met, total[place], 0) if len(known) else np.zeros(len(h), dtype=np.int64)
                # the lattice of a word is the same in all slices of the block
                was = np.minimum(np.searchsorted(done, h), max(len(done) - 1, 0))
                old = done[was] == h if len(done) else np.zeros(len(h), dtype=bool)
                marginal = np.zeros((len(h), len(live)))
                if old.any():
                    marginal[old] = done_logs[was[old]]
                marginal[~old] = spelled(model.pieces, [model.weights[k] for k in live], words, at[~old])
                done, done_logs = np.concatenate((done, h[~old])), np.concatenate((done_logs, marginal[~old]))
                order = np.argsort(done)
                done, done_logs = done[order], done_logs[order]
                logs = np.log10(novel) + marginal
                end = np.zeros(len(live))
                if n:
                    of_class = np.where(met[:, None], per_class[place], 0) if len(known) else np.zeros((len(h), len(live)))
                    with np.errstate(divide="ignore"):  # the log of no chance is -inf, which adds nothing
                        plain = np.log(own * of_class / model.tokens[live] + all_ * count[:, None] / n)
                    logs = np.logaddexp(logs * np.log(10), plain) / np.log(10)
                    end = np.log10(own * model.docs[live] / model.tokens[live] + all_ * ends / n)
                size = len(texts)
                for name, last, each in (("score", end, logs), ("lattice_score", stop, marginal + go)):
                    by_class = share + last + np.stack(
                        [np.bincount(words.doc, each[back, k], minlength=size) for k in range(len(live))], axis=1)
                    top = by_class.max(axis=1)
                    out[name].append(top + np.log10((10.0 ** (by_class - top[:, None])).sum(axis=1)))
                base = np.log10((count + 0.1) / base_of)
                out["base_score"].append(np.bincount(words.doc, base[back], minlength=size) + np.log10((ends + 0.1) / base_of))
                out["n_known"].append(np.bincount(words.doc, (count > 0)[back], minlength=size).astype(np.int64) + int(ends > 0))
                out["n_tokens"].append(np.diff(words.bounds) + 1)
        columns = {k: np.concatenate(v) for k, v in out.items()}
        del known, total, per_class, words, logs, marginal
        give_back()
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
                         "n_tokens": columns["n_tokens"], "n_known": columns["n_known"],
                         "train_tokens": np.full(docs.num_rows, n), "base_score": columns["base_score"], "score": columns["score"],
                         "lattice_score": columns["lattice_score"]})
    return run


def score_texts(docs: DataFrame, vocabulary: str, hold_out: int = HOLD_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score (log10 probabilities).

    A text is its words (ASCII lower case) and one end. Under each language the probability of a word mixes its share in the
    training documents of that language, its share in all of them, and, for the mass of novel words (the share of words seen
    once), the subword lattice: all segmentations of the word into vocabulary pieces and bytes, summed by the forward
    recursion in log space. Arc weights start from the vocabulary's own scores and are re-estimated by one step of expectation
    over the training words of each language, each word once. score sums over languages, weighed by their shares of documents; a document's
    own lang is not looked at when it is scored. lattice_score is the same without any counts of words: every word by its lattice alone.

    Training covers all documents with crc32(doc_id as text) mod hold_out not 0. Documents are dealt to blocks of about
    block_bytes; word counts are summed over the blocks by a window over (block, word) rows, which then go back to their blocks,
    so no vocabulary is ever held whole. Languages beyond the 15 most frequent share a class.

    A null text counts as empty (only the end), a null lang is a language of its own, a null doc_id the empty id. Repeated
    rows are learned from and scored each. An empty table gives an empty result. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), hold_out) == 0).alias("held_out"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    names = [r["lang"] for r in rows.filter("NOT held_out").groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAIN_CLASSES).collect()]
    numbers = F.lit(len(names))
    for i, name in enumerate(names):
        numbers = F.when(F.col("lang") == name, i).otherwise(numbers)
    classes = len(names) + 1
    rows = rows.withColumn("class", F.when(F.col("held_out"), -1).otherwise(numbers).cast("int")).drop("lang")
    pieces = Pieces.load(vocabulary)
    # every word once, however the documents are split, so that the weights do not depend on it
    fields = [f"c{k}" for k in range(classes)]
    met_words = (rows.select("class", "text").mapInArrow(training_words(classes), "word binary, " + ", ".join(f"{c} long" for c in fields))
                 .groupBy("word").agg(*[F.sum(c).alias(c) for c in fields]))
    sums = (met_words.mapInArrow(training_sums(pieces, classes), "class int, arc int, value double")
            .groupBy("class", "arc").agg(F.sum("value").alias("value")).collect())  # at most classes x arcs
    uses, facts = np.zeros((classes, len(pieces.prior))), np.zeros((classes + 1, 4))
    for r in sums:
        if r["arc"] < 0:
            facts[r["class"], -r["arc"] - 1] = r["value"]
        else:
            uses[r["class"], r["arc"]] = r["value"]
    facts = np.rint(facts).astype(np.int64)
    model = Model(pieces, facts[:-1, 1], facts[:-1, 2], [arc_weights(pieces, uses[k], float(facts[k, 0])) for k in range(classes)],
                  int(facts[-1, 0]), int(facts[-1, 3]))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    blocks = int(((size["b"] or 0) + 16 * size["n"]) // block_bytes) + 1
    # compressed, and the same columns for both readers below, so that the texts are shuffled once
    packed = f"doc_id {kind}, text binary, held_out boolean, class int, block int"
    dealt = (rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
             .mapInArrow(packed_column, packed).repartition("block").sortWithinPartitions("block"))
    live = np.flatnonzero(model.docs > 0).tolist() or [0]
    fields = [f"c{k}" for k in live]
    # one row for each block and word, which leaves with the word's counts over all blocks: texts are split, and words shuffled, once
    everywhere = Window.partitionBy("word")
    here = (dealt.mapInArrow(block_words(live), "block int, word long, " + ", ".join(f"{c} long" for c in fields))
            .select("block", "word", *[F.sum(c).over(everywhere).alias(c) for c in fields])
            .filter(" + ".join(fields) + " > 0"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return dealt.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(block_scores(model, live), schema)
