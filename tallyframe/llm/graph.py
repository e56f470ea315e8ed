"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.text import pinned

ROWS_A_TASK = 250_000
SMALL = 200_000


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges that come in: labels fall to the smallest neighbour's, then to the label's own label."""
    parts = [np.stack((np.asarray(b.column("a")), np.asarray(b.column("b")))) for b in batches]
    ends = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), dtype=np.int64)
    ends = ends[:, ends[0] != ends[1]]
    ids, flat = np.unique(ends, return_inverse=True)
    a, b = flat.reshape(ends.shape)
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge; the component is the smallest id reachable. edges: a, b (long), in any order.

    Neighbourhoods are only aggregated (min) and joined, never gathered, so a hub of any degree is no single group; each
    round is checkpointed. Every component ends as a star around its smallest id, after about log(n) rounds. A graph of up to SMALL
    edges (counted first, some MB) is closed in one task.
    """
    if edges.limit(SMALL + 1).count() <= SMALL:
        return pinned(edges.coalesce(1).mapInArrow(closed, "id long, component long"))
    stars = pinned(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(stars)
    while True:
        few = 1 + before[0] // ROWS_A_TASK  # a small graph is no reason for many small shuffle files
        stars = stars.coalesce(few)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v"))
        stars = pinned(small.filter("u <> v").coalesce(few).distinct().coalesce(few))
        now = _state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        stars.select("v", "v").distinct())
