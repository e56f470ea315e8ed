"""Repeated word windows, found through content-selected anchors.

For every window of L words the smallest of its k-word hashes (the leftmost of equals) marks an anchor, so equal windows
have the same anchor wherever they stand. Neighbouring windows with one anchor form a segment. The work goes

1. one row per (anchor hash, document): anchors of a single document are dropped (aggregate, then a join that may be split);
2. the documents' live segments as hashes, equal ones collapsed to the smallest and largest doc_id;
3. the words of each different segment, taken from its first document only;
4. a search within shards of whole anchors (passed in by the operator), which gives the smallest doc_id of each window;
5. back to the segments of each document, and to its text.

An anchor of more than HOT documents is split: its windows travel one by one, keyed by their own hash, so that a
passage in a third of all documents spreads over the shards and its copies collapse before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.text import SLICE_BYTES, U64, Words, mix, slices, small_batches, span_hashes, split_words

HOT = 10_000
SHARD_WORDS = 400_000
NO_ID = -(1 << 63)
ANCHOR_BITS = U64((1 << 48) - 1)  # shorter keys shuffle in less space; anchors that meet by chance cost work, not results

# search(words, segment bounds, anchor offsets, windows per segment, smallest ids) -> smallest id of each window
Search = Callable[[Words, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    n = len(x) - k + 1
    h = np.zeros(max(n, 0), dtype=U64)
    for j in range(k):
        h = h * U64(0xD6E8FEB86659FD93) + x[j:j + len(h)]
    return mix(h)


def leftmost_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost smallest value of g[i:i + width]."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, span = np.arange(len(g)), 1
    while span * 2 <= width:
        left, right = at[:len(at) - span], at[span:]
        at = np.where(g[right] < g[left], right, left)
        span *= 2
    left, right = at[:n], at[width - span:width - span + n]
    return np.where(g[right] < g[left], right, left)


def segments(words: Words, length: int, k: int):
    """First window, number of windows, anchor place and anchor hash of each segment."""
    g = gram_hashes(words.hashes, k)
    owner = leftmost_minimum(g, length - k + 1)
    valid = np.flatnonzero(words.doc[:len(owner)] == words.doc[length - 1:length - 1 + len(owner)])
    if not len(valid):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=U64)
    g &= ANCHOR_BITS
    mine = owner[valid]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1))
    first = valid[cut]
    count = np.diff(np.concatenate((cut, [len(valid)])))
    return first, count, mine[cut], g[mine[cut]]


def packed_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle; other columns as they are."""
    press = zstandard.ZstdCompressor(level=1)
    for rows, texts in slices(batches):
        at = rows.schema.get_field_index("text")
        yield rows.set_column(at, "text", pa.array([t if t is None else press.compress(t) for t in texts], pa.binary()))


def unpacked(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    open_up = zstandard.ZstdDecompressor()
    for rows, texts in slices(batches, size=size):
        yield rows, [t if t is None else open_up.decompress(t) for t in texts]


def document_anchors(length: int, k: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            words = split_words(texts)
            first, _, _, gram = segments(words, length, k)
            order = np.lexsort((gram, words.doc[first]))
            doc, gram = words.doc[first][order], gram[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (np.diff(doc) != 0) | (gram[1:] != gram[:-1])
            ids = [rows.column(n).take(pa.array(doc[new])) for n in keys]
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), *ids], ["anchor", *keys])
    return run


def _live_segments(words: Words, live: list[np.ndarray], hot: list[np.ndarray], length: int, k: int):
    """Segments with a live anchor; those of hot anchors as single windows. Adds route and content hash."""
    first, count, at, gram = segments(words, length, k)
    doc = words.doc[first]
    cuts = np.searchsorted(doc, np.arange(len(words.bounds)))
    state = np.zeros(len(first), dtype=np.int8)
    for i in range(len(words.bounds) - 1):
        if len(live[i]) and cuts[i] < cuts[i + 1]:
            mine = gram[cuts[i]:cuts[i + 1]]
            place = np.minimum(np.searchsorted(live[i], mine), len(live[i]) - 1)
            found = live[i][place] == mine
            state[cuts[i]:cuts[i + 1]] = np.where(found, 1 + hot[i][place], 0)
    whole, split = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
    each = np.repeat(split, count[split])
    step = np.arange(len(each)) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
    start = np.concatenate((first[whole], first[each] + step))
    number = np.concatenate((count[whole], np.ones(len(each), dtype=count.dtype)))
    anchor = np.concatenate((at[whole], at[each])) - start
    content = span_hashes(words.hashes, start, start + number + length - 1)
    content = mix(content + (anchor.astype(U64) << U64(32)) + number.astype(U64))
    route = np.concatenate((gram[whole], content[len(whole):]))
    return start, number, anchor, route, content


def list_lengths(column: pa.Array) -> np.ndarray:
    """Entries of each list; none in a null."""
    return np.asarray(pa.compute.list_value_length(column).fill_null(0)).astype(np.int64)


def _live(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted anchors of each row and their marks. Nested columns are read as flat arrays here and below: as Python objects they cost more
    than all other work on a text."""
    size, flat = list_lengths(column), column.flatten()
    keys, hot = np.asarray(flat.field("anchor")).view(U64), np.asarray(flat.field("hot")).astype(np.int8)
    order = np.lexsort((keys, np.repeat(np.arange(len(size)), size)))
    cuts = np.cumsum(size)[:-1]
    return np.split(keys[order], cuts), np.split(hot[order], cuts)


def segment_places(length: int, k: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in unpacked(batches):
            words = split_words(texts)
            start, _, _, route, content = _live_segments(words, *_live(rows.column("live")), length, k)
            doc = words.doc[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(content.view(np.int64)), *(rows.column(n).take(pa.array(doc)) for n in keys),
                 pa.array(start - words.bounds[doc])], ["route", "content", *keys, "start"])
    return run


def segment_words(length: int, k: int):
    """The words of the segments that the document is the first to have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in unpacked(batches):
            words = split_words(texts)
            start, number, anchor, route, content = _live_segments(words, *_live(rows.column("live")), length, k)
            doc = words.doc[start]
            wanted = rows.column("wanted").flatten()
            wanted_doc = np.repeat(np.arange(len(texts)), list_lengths(rows.column("wanted")))
            # places by (document, route, content); a repeated segment is taken once
            have = np.lexsort((content, route, doc))
            lead = np.ones(len(have), dtype=bool)
            a, b = have[1:], have[:-1]
            lead[1:] = (doc[a] != doc[b]) | (route[a] != route[b]) | (content[a] != content[b])
            have = have[lead]
            # both lists in one order: a segment that is asked for stands right before the entry that asks for it
            both = [np.concatenate((mine[have], asked)) for mine, asked in (
                (doc, wanted_doc), (route, np.asarray(wanted.field("route")).view(U64)), (content, np.asarray(wanted.field("content")).view(U64)))]
            order = np.lexsort((np.arange(len(both[0])) >= len(have), both[2], both[1], both[0]))
            a, b = order[:-1], order[1:]
            met = (a < len(have)) & (b >= len(have)) & (both[0][a] == both[0][b]) & (both[1][a] == both[1][b]) & (both[2][a] == both[2][b])
            pick, last = have[a[met]], np.asarray(wanted.field("last_id"))[b[met] - len(have)]
            first, end = start[pick].tolist(), (start[pick] + number[pick] + length - 1).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(route[pick].view(np.int64)), pa.array(content[pick].view(np.int64)),
                 rows.column("doc_id").take(pa.array(doc[pick])), pa.array(last),
                 pa.array(number[pick].astype(np.int32)), pa.array(anchor[pick].astype(np.int32)),
                 pa.array([words.text(i, j) for i, j in zip(first, end)], pa.binary())],
                ["route", "content", "first_id", "last_id", "windows", "anchor_at", "words"])
    return run


def shard_search(length: int, search: Search):
    """Rows sorted by route; shards of about SHARD_WORDS words are cut between routes and searched one by one."""
    def shard(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        words = split_words(pdf["words"].tolist())
        number = pdf["windows"].to_numpy(np.int64)
        smallest, largest = pdf["first_id"].to_numpy(np.int64), pdf["last_id"].to_numpy(np.int64)
        found = search(words, pdf["anchor_at"].to_numpy(np.int64), number, smallest)
        cut = np.concatenate(([0], np.cumsum(number)))
        shared = np.minimum.reduceat(found, cut[:-1]) < largest  # else a single document has all its windows
        return pd.DataFrame({"route": pdf["route"][shared], "content": pdf["content"][shared],
                             "seen": pd.Series([found[cut[i]:cut[i + 1]] for i in np.flatnonzero(shared)], dtype=object,
                                               index=pdf.index[shared])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            lengths = (frame["windows"].to_numpy(np.int64) + length).cumsum()
            while len(frame):
                route = frame["route"].to_numpy()
                full = np.flatnonzero((lengths + size >= SHARD_WORDS)[:-1] & (route[1:] != route[:-1]))
                if size >= SHARD_WORDS and held and held[-1]["route"].iloc[-1] != route[0]:
                    yield shard(held)
                    held, size = [], 0
                    continue
                if not len(full):
                    held.append(frame)
                    size += int(lengths[-1])
                    break
                cut = int(full[0]) + 1
                yield shard([*held, frame.iloc[:cut]])
                held, size = [], 0
                frame, lengths = frame.iloc[cut:], lengths[cut:] - lengths[cut - 1]
        if held:
            yield shard(held)
    return run


def covered(words: Words, doc_id: pa.Array, hits: pa.Array, length: int) -> np.ndarray:
    """Mask of the words that lie in a window whose smallest id is less than the document's own. hits: of each document, start and seen,
    the smallest ids of the windows from there on."""
    n, flat = list_lengths(hits), hits.flatten()
    ids = np.asarray(doc_id.fill_null(NO_ID)).repeat(n)
    size = list_lengths(flat.field("seen"))
    first = np.asarray(flat.field("start")) + words.bounds[:-1].repeat(n)
    gone = np.flatnonzero(np.asarray(flat.field("seen").flatten()) < ids.repeat(size))
    start = gone + (first - (np.cumsum(size) - size)).repeat(size)[gone]
    total = len(words.doc) + 1
    return np.cumsum(np.bincount(start, minlength=total) - np.bincount(start + length, minlength=total))[:-1] > 0


def document_results(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in unpacked(batches):
            words = split_words(texts)
            bounds = words.bounds
            gone = covered(words, rows.column("doc_id"), rows.column("hits"), length)
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])
            # ranges of removed words; the first word of a document begins one of its own
            apart = np.append(words.doc[1:] != words.doc[:-1], True)
            begin = np.flatnonzero(gone & np.append(True, ~gone[:-1] | apart[:-1])[:len(gone)])
            end = np.flatnonzero(gone & (np.append(~gone[1:], True) | apart)[:len(gone)]) + 1
            cuts = np.searchsorted(words.doc[begin], np.arange(len(texts) + 1))
            own = bounds[words.doc[begin]]
            spans = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(begin - own), pa.array(end - own)], fields=list(SPANS.value_type)))
            kept, digests, begin, end = [], [], begin.tolist(), end.tolist()
            for i, (a, b, n, p, q) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), removed.tolist(), cuts[:-1].tolist(), cuts[1:].tolist())):
                data = words.text(a, b) if not n else b" ".join(
                    words.text(s, e) for s, e in zip([a, *end[p:q]], [*begin[p:q], b]) if e > s)
                digests.append(hashlib.sha256(data).hexdigest())
                if with_text:
                    # a text that loses nothing stays as it is, blanks included
                    kept.append(data.decode() if n else None if texts[i] is None else texts[i].decode())
            arrays = [rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed), spans, pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)
    return run


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def remove_repeats(docs: DataFrame, length: int, k: int, search: Search, with_text: bool) -> DataFrame:
    """One row per document: words covered by a window that also starts in a document with a smaller doc_id are removed.

    docs needs doc_id (integers) and text. Rows with one doc_id and different texts are documents of their own, none of them smaller
    than another; rows with a null doc_id remove nothing and lose nothing. Rows: doc_id, n_words, n_removed, spans (ranges of removed words),
    kept_sha256 and, if asked for, kept_text.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a row is known by its id (doc_key is never null, so that both joins below share one shuffle of the texts); only where an id
    # comes with different texts, a hash of the text goes with it
    digest = F.coalesce(F.xxhash64("text"), F.lit(0))
    clash = not (source.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
                 .filter("low <> high").isEmpty())
    more = ["text_key"] if clash else []
    source = source.withColumn("text_key", digest) if clash else source
    keys, key = ["doc_id", *more], ["doc_key", *more]
    named = ", ".join(f"{c} long" for c in keys)
    own = [F.col("doc_id").alias("doc_key"), *more]
    base = (source.select(*keys, "text").mapInArrow(packed_column, f"{named}, text binary")
            .withColumn("doc_key", F.coalesce("doc_id", F.lit(NO_ID))).repartition(*key))
    anchors = source.filter("doc_id IS NOT NULL").mapInArrow(document_anchors(length, k, keys), f"anchor long, {named}")
    live = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select(
        "anchor", (F.col("n") > HOT).cast("int").alias("hot"))
    marked = anchors.join(live, "anchor").groupBy(*own).agg(F.collect_list(F.struct("anchor", "hot")).alias("live"))
    withal = base.join(marked, key)
    places = withal.mapInArrow(segment_places(length, k, keys), f"route long, content long, {named}, start long")
    smallest = F.min(F.struct(*own)) if clash else F.struct(F.min("doc_id").alias("doc_key"))
    first = (places.groupBy("route", "content").agg(smallest.alias("first"), F.max("doc_id").alias("last_id"))
             .groupBy(*[F.col(f"first.{c}").alias(c) for c in key]).agg(F.collect_list(F.struct("route", "content", "last_id")).alias("wanted")))
    distinct = withal.join(first, key).mapInArrow(
        segment_words(length, k), "route long, content long, first_id long, last_id long, windows int, anchor_at int, words binary")
    found = (distinct.repartition("route").sortWithinPartitions("route", "content")
             .mapInPandas(shard_search(length, search), "route long, content long, seen array<long>"))
    hits = (places.join(found, ["route", "content"]).filter(F.expr("exists(seen, x -> x < doc_id)"))
            .groupBy(*own).agg(F.collect_list(F.struct("start", "seen")).alias("hits")))
    schema = ("doc_id long, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept_sha256 string"
              + ", kept_text string" * with_text)
    return base.join(hits, key, "left").mapInArrow(document_results(length, with_text), schema)
