"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.text import pinned, slices, split_words

TOPICS = 8
TOPIC_LETTERS = 5  # shorter words, mostly function words, do not count for the topic
SMOOTHING = 0.8
SWEEPS, TOLERANCE = 60, 1e-7
DRIVER_CELLS = 200_000
LEAST_SHARE = 0.001  # of the tokens; smaller categories are raked together
LIFT, MOST = 2.0, 4.0  # bounds of the default targets: of a category's share over its present one, and of a cell's multiplier
MARGINS = ("source", "lang", "topic")


def tokens_and_topics(topics: int):
    """Adds n_tokens (words) and topic: the hash bucket that most of a text's longer words fall in, -1 if it has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            words = split_words(texts)
            long = words.ends - words.starts >= TOPIC_LETTERS
            slot = (words.hashes[long] >> np.uint64(40)) % np.uint64(topics)
            counts = np.bincount(words.doc[long] * topics + slot.astype(np.int64), minlength=len(texts) * topics).reshape(-1, topics)
            topic = np.where(counts.any(axis=1), counts.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("source"), rows.column("lang"), pa.array(topic.astype(np.int32)),
                 pa.array(np.diff(words.bounds)), rows.column("text_hash")], ["doc_id", "source", "lang", "topic", "n_tokens", "text_hash"])
    return run


def margin(cells: DataFrame, name: str, weight: str) -> DataFrame:
    return cells.groupBy(name).agg(F.sum(weight).alias("m"))


def joined_categories(cells: DataFrame, name: str, least: float) -> DataFrame:
    """name and as_<name>: categories with less than `least` of the tokens are one; if that is less, too, the smallest other one."""
    sizes = pinned(margin(cells, name, "tokens"))
    bound = F.lit(least * float(sizes.agg(F.sum("m")).first()[0] or 0))
    small = F.col("m") < bound
    facts = sizes.agg(F.min(F.when(small, F.col(name))).alias("first"), (F.sum(F.when(small, F.col("m"))) >= bound).alias("enough"),
                      F.min(F.when(~small, F.struct("m", name))).alias("smallest")).first()
    place = facts["first"] if facts["enough"] or facts["smallest"] is None else facts["smallest"][name]
    return sizes.select(name, F.when(small, F.lit(place)).otherwise(F.col(name)).alias(f"as_{name}"))


def smoothed_targets(cells: DataFrame, name: str, smoothing: float, lift: float = LIFT) -> DataFrame:
    """Shares in proportion to a power below one of the present shares: large categories give to small ones.

    No share is above lift times the present one; what a bound category leaves goes to the others in proportion. cells has
    joined categories, so these are few.
    """
    rows = margin(cells, name, "tokens").collect()
    now = np.array([r["m"] for r in rows], dtype=np.float64)
    now /= max(now.sum(), 1.0)
    raised, bound = now ** smoothing, np.zeros(len(now), dtype=bool)
    share = raised
    while len(rows):
        share = np.where(bound, lift * now, raised * (1 - lift * now[bound].sum()) / raised[~bound].sum())
        over = ~bound & (share > lift * now * (1 + 1e-12))
        if not over.any():
            break
        bound |= over
    return cells.sparkSession.createDataFrame([(r[name], float(v)) for r, v in zip(rows, share)],
                                              f"{name} {dict(cells.dtypes)[name]}, share double")


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE,
         driver_cells: int = DRIVER_CELLS, most: float = float("inf")) -> DataFrame:
    """cells (the margins' columns, tokens > 0) with weight: shares that meet every target margin as nearly as the cells allow.

    Each sweep scales the weights to one margin after the other; the last is after `sweeps`, or when no margin is off by more
    than tolerance. A sweep ends by cutting weights to `most` times the cell's share of tokens; the next one rakes what was
    cut to the rest. Up to driver_cells cells (counted first) are swept as arrays in the driver, more by aggregates and joins.
    """
    way = _rake_arrays if cells.limit(driver_cells + 1).count() <= driver_cells else _rake_tables
    return way(cells, targets, sweeps, tolerance, most)


def _rake_arrays(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float, most: float) -> DataFrame:
    rows = cells.collect()
    weight = np.array([r["tokens"] for r in rows], dtype=np.float64)
    weight /= max(weight.sum(), 1.0)
    bound = most * weight
    places, shares = [], []
    for name, target in targets.items():
        share = {r[name]: r["share"] for r in target.collect()}
        values = {v: i for i, v in enumerate(sorted({r[name] for r in rows}))}
        places.append(np.array([values[r[name]] for r in rows], dtype=np.int64))
        shares.append(np.array([share.get(v, 0.0) for v in values]))
    for _ in range(sweeps if rows else 0):
        off = 0.0
        for place, share in zip(places, shares):
            now = np.bincount(place, weight, minlength=len(share))
            off = max(off, float(np.abs(now - share).max()))
            weight *= np.divide(share, now, out=np.zeros_like(share), where=now > 0)[place]
        weight = np.minimum(weight, bound)
        if off <= tolerance:
            break
    out = [(*(r[n] for n in MARGINS), r["tokens"], float(w)) for r, w in zip(rows, weight)]
    return cells.sparkSession.createDataFrame(out, cells.withColumn("weight", F.lit(0.0)).schema)


def _rake_tables(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float, most: float) -> DataFrame:
    total, columns = cells.agg(F.sum("tokens")).first()[0], [*cells.columns, "weight"]
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for _ in range(sweeps):
        off = 0.0
        for name, target in targets.items():
            factor = pinned(margin(cells, name, "weight").join(target, name, "left").select(
                name, F.abs(F.coalesce("share", F.lit(0.0)) - F.col("m")).alias("gap"),
                F.when(F.col("m") > 0, F.coalesce("share", F.lit(0.0)) / F.col("m")).otherwise(0.0).alias("f")))
            off = max(off, factor.agg(F.max("gap")).first()[0] or 0.0)
            cells = pinned(cells.join(factor.select(name, "f"), name).withColumn("weight", F.col("weight") * F.col("f")).drop("f"))
        cells = cells.withColumn("weight", F.least("weight", F.lit(most) * F.col("tokens") / F.lit(float(total or 1))))
        if off <= tolerance:
            break
    return cells.select(*columns)


def mix_to_targets(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topics: int = TOPICS,
                   smoothing: float = SMOOTHING, seed: int = 11, least_share: float = LEAST_SHARE, most: float | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, multiplier, probability, kept.

    Documents fall in cells of (source, lang, topic). Cell weights start as token shares and are raked to the target
    margins: targets[name] has the columns name and share; without targets, each margin aims at its token shares to the power
    `smoothing`. multiplier is a cell's raked share over its share of tokens, probability the multiplier over the largest
    one, so that expected token shares of the sample are the raked ones exactly. A document is kept if a hash of its id and
    the seed, as a number in [0, 1), is below its probability: the same documents in every run.

    The largest multiplier sets the size of the sample, so no few texts may set it: in a margin without given targets,
    categories with less than least_share of the tokens are raked together (joined_categories) and a category's target is at
    most LIFT times its present share. Without any given targets a multiplier is at most MOST, so the expected sample has at
    least 1 / MOST of the tokens; given targets are met however small the sample gets, unless `most` is set. topic is the topic
    a text is raked in; source and lang are its own.

    A null source or lang is a category of its own, written as the empty string. A text without words has no tokens, topic -1
    and, as it moves no weight, probability 1. Rows with the same doc_id draw the same number. An empty table gives an empty
    result. Extra columns are not read.
    """
    return _mixed(docs, targets, topics, smoothing, seed, least_share, most).drop("text_hash")


def _categories() -> dict[str, Column]:
    return {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("source", "lang")}


def _mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topics: int = TOPICS, smoothing: float = SMOOTHING,
           seed: int = 11, least_share: float = LEAST_SHARE, most: float | None = None) -> DataFrame:
    """The rows of mix_to_targets with text_hash."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = pinned(docs.select("doc_id", "text", *[c.alias(n) for n, c in _categories().items()], F.xxhash64("text").alias("text_hash"))
                  .mapInArrow(tokens_and_topics(topics),
                              f"doc_id {kind}, source string, lang string, topic int, n_tokens long, text_hash long"))
    given = targets or {}
    own = pinned(rows.filter("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    for name in MARGINS:
        own = (own.withColumn(f"as_{name}", F.col(name)) if name in given
               else own.join(joined_categories(own, name, least_share), name))
    own = pinned(own)
    cells = pinned(own.groupBy(*[F.col(f"as_{n}").alias(n) for n in MARGINS]).agg(F.sum("tokens").alias("tokens")))
    aims = {n: pinned(given[n] if n in given else smoothed_targets(cells, n, smoothing)) for n in MARGINS}
    raked = rake(cells, aims, most=most or (float("inf") if given else MOST))
    total = cells.agg(F.sum("tokens")).first()[0]
    scored = raked.withColumn("multiplier", F.col("weight") * F.lit(float(total or 1)) / F.col("tokens"))
    largest = scored.agg(F.max("multiplier")).first()[0]
    scored = scored.select(*[F.col(n).alias(f"as_{n}") for n in MARGINS], "multiplier",
                           (F.col("multiplier") / F.lit(float(largest or 1))).alias("probability"))
    scored = own.drop("tokens").join(scored, [f"as_{n}" for n in MARGINS])
    number = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (rows.join(scored, list(MARGINS), "left")
            .select("doc_id", "source", "lang", F.coalesce("as_topic", "topic").alias("topic"), "n_tokens",
                    F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"),
                    F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0))).alias("probability"), "text_hash")
            .withColumn("kept", number < F.col("probability")))


def keep_mixture(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, all columns as they are. Every row has its own decision, also where a doc_id is null or repeated."""
    kept = _mixed(docs, **options).filter("kept").select("doc_id", "source", "lang", "text_hash").distinct().toDF(
        "kept_doc_id", "kept_source", "kept_lang", "kept_text_hash")
    ours = {"doc_id": docs["doc_id"], **_categories(), "text_hash": F.xxhash64("text")}
    same = [c.eqNullSafe(kept[f"kept_{n}"]) for n, c in ours.items()]
    return docs.join(kept, same, "left_semi").select(docs.columns)
