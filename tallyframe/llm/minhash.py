"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.anchors import gram_hashes
from tallyframe.llm.graph import components
from tallyframe.llm.text import U64, mix, pinned, slices, span_hashes, split_words

SHINGLE = 5
BINS, BANDS = 128, 32
GROWTH = 16
RARE = 12
ROWS_A_TASK = 25_000  # rows of buckets; tables that follow from them are read in so many tasks a row, pairs in PAIR_TASKS times as many
PAIR_TASKS = 16
MULTIPLIER = U64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the bounds of each text's set."""
    words = split_words([t.lower() if t else t for t in texts])  # bytes: only A-Z change
    size = np.diff(words.bounds)
    n = len(words.doc)
    long = np.flatnonzero(words.doc[:max(n - width + 1, 0)] == words.doc[min(width - 1, n):])
    short = np.flatnonzero((size > 0) & (size < width))
    doc = np.concatenate((words.doc[long], short))
    value = np.concatenate((gram_hashes(words.hashes, width)[long],
                            span_hashes(words.hashes, words.bounds[short], words.bounds[short + 1])))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minima per bin; an empty bin takes that of a filled one, tried in an order of its own."""
    count = len(bounds) - 1
    doc = np.repeat(np.arange(count), np.diff(bounds))
    slot = (value >> U64(64 - bins.bit_length() + 1)).astype(np.int64)
    lead = np.ones(len(value), dtype=bool)
    lead[1:] = (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1])
    out = np.zeros((count, bins), dtype=U64)
    full = np.zeros((count, bins), dtype=bool)
    out[doc[lead], slot[lead]] = value[lead]
    full[doc[lead], slot[lead]] = True
    row, column = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix(column.astype(U64) * U64(1 << 32) + U64(attempt)) & U64(bins - 1)).astype(np.int64)
        hit = full[row, source]
        out[row[hit], column[hit]] = out[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    key = np.zeros(parts.shape[:2], dtype=U64)
    for j in range(parts.shape[2]):
        key = key * MULTIPLIER + parts[:, :, j]
    return mix(key + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketch(width: int, bins: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            value, bounds = shingle_sets(texts, width)
            size = np.diff(bounds)
            keys = band_keys(signatures(value, bounds, bins), bands)
            one = span_hashes(value, bounds[:-1], bounds[1:])
            two = span_hashes(mix(value), bounds[:-1], bounds[1:])
            offsets = np.arange(len(size) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"])
    return run


def full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            value, bounds = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                ["id", "members"])
    return run


def single_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        size = np.asarray(pa.compute.binary_length(members)).astype(np.int64) // 8
        value = np.frombuffer(b"".join(members.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(value), batch.column("id").take(pa.array(np.repeat(np.arange(len(size)), size)))],
                                         ["shingle", "id"])


def confirm(percent: int):
    """Keeps the pairs whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                one, two = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
                both = np.concatenate((one, two))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = SHINGLE, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct word shingles (ASCII lower case); with fewer words than a shingle has, the whole
    sequence is one. Documents are linked if 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable over links and kept marks that document.

    Equal sets collapse to one representative before anything else. Representatives meet in buckets of equal bands
    (128 bins in 32 bands of 4: a pair at 0.75 is missed about 5 times in a million). Each bucket is a star around its hub; a
    document's edge to the hub that it shares most buckets with is confirmed on the full sets. Only buckets whose members are not in one component after that go
    on. Pairs of their documents that share a shingle of at most RARE of these documents are compared (fewer than RARE / 2 pairs for
    each shingle of a document). No other pair has such a shingle in its intersection, which bounds its similarity by the shingles
    that remain and leaves out documents that cannot reach the threshold with them; then further hubs, 16 times as many each round,
    are compared with members of other components until all pairs are decided. A large group of copies costs a few stars, a
    group with edits of their own or in small cliques a few pairs a document, and no link between components is left out.

    Null, empty and blank texts have an empty set, are linked with nothing and kept. Repeated texts are one set. An empty
    table gives an empty result. Extra columns are not read. doc_id must be unique; rows with a null doc_id are linked with
    nothing and kept, too.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = pinned(base.mapInArrow(sketch(width, bins, bands),
                                   "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    key = ["n_shingles", "set_a", "set_b"]
    sets = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    placed = sets.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    crowd = pinned(placed.join(shared.select("bucket", "hub"), "bucket"))
    # the shuffles and checkpoints below are many: where few rows are dealt over many partitions, a task reads several
    tasks = 1 + crowd.count() // ROWS_A_TASK
    many = tasks * PAIR_TASKS
    crowd = crowd.coalesce(tasks)
    members = pinned(base.join(crowd.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
                     .mapInArrow(full_sets(width), "id long, members binary")).coalesce(tasks)

    def links(pairs: DataFrame) -> DataFrame:
        """pairs: a, b, size_a, size_b."""
        near = pairs.filter(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)").select("a", "b")
        near = near.coalesce(many).distinct().coalesce(many)
        withal = (near.join(members.select(F.col("id").alias("b"), F.col("members").alias("right")), "b").coalesce(many)
                  .join(members.select(F.col("id").alias("a"), F.col("members").alias("left")), "a").coalesce(many))
        return pinned(withal.select("a", "b", "left", "right").mapInArrow(confirm(percent), "a long, b long")).coalesce(tasks)

    def unsettled(frame: DataFrame, label: DataFrame) -> DataFrame:
        """The rows of the buckets that hold more than one component."""
        named = frame.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")).coalesce(tasks)
        several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        return named.join(several.select("bucket"), "bucket").coalesce(tasks)

    # each document with the hub it shares most buckets with; what that leaves open is for the rounds below
    spokes = crowd.filter("id <> hub").groupBy("id", "n_shingles", "hub").agg(F.count("*").alias("met"))
    nearest = spokes.groupBy("id", "n_shingles").agg(F.max(F.struct("met", (-F.col("hub")).alias("less"))).alias("best"))
    sizes = crowd.groupBy("id").agg(F.first("n_shingles").alias("size_a"))
    first = nearest.select((-F.col("best.less")).alias("a"), F.col("id").alias("b"), F.col("n_shingles").alias("size_b"))
    edges = links(first.join(sizes.withColumnRenamed("id", "a"), "a"))
    label = components(edges)
    rest = pinned(unsettled(crowd, label))
    if not rest.isEmpty():
        # shingles of few of these documents: a pair that shares one is compared; in any other pair's intersection there is none
        single = members.join(rest.select("id").distinct(), "id", "left_semi").select("id", "members").mapInArrow(single_shingles, "shingle long, id long").coalesce(many)
        few = pinned(single.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter(f"n <= {RARE}").coalesce(many))
        postings = pinned(single.join(few.filter("n > 1").select("shingle"), "shingle").groupBy("shingle").agg(F.collect_list("id").alias("ids")).coalesce(many))
        rare = (few.filter("n = 1").select("id").union(postings.select(F.explode("ids").alias("id"))).groupBy("id").agg(F.count("*").alias("rare")))
        meet = (postings.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).filter("a < b").distinct()
                .join(rest.select(F.col("id").alias("a"), F.col("n_shingles").alias("size_a"), F.col("component").alias("of_a")).distinct(), "a")
                .join(rest.select(F.col("id").alias("b"), F.col("n_shingles").alias("size_b"), F.col("component").alias("of_b")).distinct(), "b"))
        found = links(meet.filter("of_a <> of_b"))
        if not found.isEmpty():
            edges = edges.union(found)
            label = components(edges)
        rest = rest.join(rare, "id", "left").withColumn("common", F.expr("n_shingles - coalesce(rare, 0)")).filter(
            f"100 * common >= {percent} * n_shingles").select(
            "bucket", "id", "n_shingles", "common", F.expr("pmod(xxhash64(id), 1073741824) / 1073741824D").alias("draw"))
        sized = rest.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by("id", F.struct(
            (-F.col("common") / F.col("n_shingles")).alias("less"), "id")).alias("hub"))
        rest = pinned(rest.join(sized.filter("size > 1"), "bucket").coalesce(tasks))
        members = pinned(members.join(rest.select("id").distinct(), "id", "left_semi").coalesce(tasks))  # no other is compared any more
    # round 0 takes the document with the fewest shingles of its own as hub, the next ones GROWTH times as many drawn hubs each
    step = 0
    while True:
        low, high = (0 if step < 2 else GROWTH ** (step - 1)), GROWTH ** step
        left = rest if rest.isEmpty() else pinned(unsettled(rest, label).filter(f"size > {low}"))
        if left.isEmpty():
            break
        # each document with all its buckets, so that a pair comes out of the first one in which both meet and of no other
        facts = ["id", "n_shingles", "common", "component", "draw"]
        whole = left.groupBy(*facts).agg(F.collect_list(F.struct("bucket", "size", "hub")).alias("b")).coalesce(tasks)
        mine = whole.select(*facts, F.transform("b", lambda b: b["bucket"]).alias("mine"), F.inline("b")).drop("size", "hub")
        hubs = whole.select(*[F.col(c).alias(f"{c}_a") for c in facts], F.filter("b", lambda b: (b["hub"] == F.col("id")) if step == 0 else (
            (F.col("draw") * b["size"] >= low) & (F.col("draw") * b["size"] < high))).alias("h")).filter("size(h) > 0")
        hubs = hubs.select("*", F.transform("h", lambda b: b["bucket"]).alias("ours")).select("*", F.inline("h")).drop("h", "size", "hub")
        later = "id <> id_a" if step == 0 else "(draw > draw_a OR draw = draw_a AND id > id_a)"
        bound = f"(100 + {percent}) * least(common, common_a) >= {percent} * (n_shingles + n_shingles_a)"
        pairs = mine.join(hubs, (mine["bucket"] == hubs["bucket"]) & F.expr(f"component <> component_a AND {later} AND {bound}")
                          & (mine["bucket"] == F.array_min(F.array_intersect("mine", "ours")))).selectExpr(
            "least(id_a, id) AS a", "greatest(id_a, id) AS b", "n_shingles_a AS size_a", "n_shingles AS size_b")
        found = links(pairs)
        if not found.isEmpty():
            edges = edges.union(found)
            label = components(edges)
        step += 1
    owner = sets.select(*key, "id").join(label, "id", "left").select(*key, F.coalesce("component", "id").alias("of"))
    return (drawn.drop("bands").join(owner, key, "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents of docs that near_duplicates keeps, all columns as they are; those with a null doc_id are among them."""
    flags = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias("kept_doc_id"))
    return docs.join(flags, docs["doc_id"].eqNullSafe(flags["kept_doc_id"]), "left_semi").select(docs.columns)
