"""Exact top-k by inner product: tiles of query blocks against candidate shards, partial selection, tree merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.text import pinned

SHARD_ROWS, QUERY_ROWS = 4096, 1024
FAN_IN = 16
BLOCK_FIELDS = ["ids", "values", "rows", "width"]


def packed_blocks(rows: int, scale: float):
    """Usable vectors as integer matrices of at most `rows` rows; shorter vectors are padded with 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            size = np.asarray(pa.compute.list_value_length(vectors).fill_null(0)).astype(np.int64)
            flat = vectors.flatten().cast(pa.float64())
            value = np.asarray(flat.fill_null(float("nan")), dtype=np.float64)
            owner = np.repeat(np.arange(len(size)), size)
            good = np.asarray(vectors.is_valid()) & np.asarray(batch.column("vec_id").is_valid())
            good[owner[~np.isfinite(value)]] = False
            column = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            ids = np.asarray(batch.column("vec_id").fill_null(0)).astype(np.int64)
            keep = np.flatnonzero(good)
            for a in range(0, len(keep), rows):
                part = keep[a:a + rows]
                row = np.full(len(size), -1)
                row[part] = np.arange(len(part))
                inside = row[owner] >= 0 if len(owner) else np.zeros(0, dtype=bool)
                matrix = np.zeros((len(part), int(size[part].max(initial=0))), dtype=np.int64)
                matrix[row[owner[inside]], column[inside]] = np.floor(scale * value[inside]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[part].tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()),
                     pa.array([len(part)], pa.int32()), pa.array([matrix.shape[1]], pa.int32())], BLOCK_FIELDS)
    return run


def blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """One row per matrix, with a number that stays as it is once checkpointed."""
    packed = vectors.mapInArrow(packed_blocks(rows, scale), "ids binary, values binary, rows int, width int")
    return pinned(packed.withColumn("block", F.monotonically_increasing_id()))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products: as doubles (fast matrix product) while every partial sum is below 2^53."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(width, 1)
    if largest < 2.0 ** 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def tile_tops(k: int):
    def matrix(batch: pa.RecordBatch, i: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        rows, width = batch.column(f"{name}_rows")[i].as_py(), batch.column(f"{name}_width")[i].as_py()
        ids = np.frombuffer(batch.column(f"{name}_ids")[i].as_buffer(), np.int64) if rows else np.zeros(0, np.int64)
        data = batch.column(f"{name}_values")[i].as_buffer()
        return ids, np.frombuffer(data, np.int64).reshape(rows, width) if width else np.zeros((rows, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries = matrix(batch, i, "q")
                ids, shard = matrix(batch, i, "c")
                score = products(queries, shard)
                other = ids[None, :] != query_ids[:, None]
                order_ids = np.argsort(ids, kind="stable")  # columns by id, so that equal scores come by smaller id
                score, other, ids = score[:, order_ids], other[:, order_ids], ids[order_ids]
                out_q, out_n, neg, vec = [], [], [], []
                for q in range(len(query_ids)):
                    cand = np.flatnonzero(other[q])
                    mine = score[q, cand]
                    if len(mine) > k:
                        bound = np.partition(mine, len(mine) - k)[len(mine) - k]
                        near = np.flatnonzero(mine >= bound)
                        cand, mine = cand[near], mine[near]
                    top = np.argsort(-mine, kind="stable")[:k]
                    if len(top):
                        out_q.append(q)
                        out_n.append(len(top))
                        neg.append(-mine[top])
                        vec.append(ids[cand[top]])
                offsets = np.concatenate(([0], np.cumsum(out_n))).astype(np.int32)
                entries = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(neg) if neg else np.zeros(0, np.int64)),
                     pa.array(np.concatenate(vec) if vec else np.zeros(0, np.int64))], ["less", "vec_id"])
                n = len(out_q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(out_q, dtype=np.int64)), pa.array(query_ids[out_q] if n else np.zeros(0, np.int64)),
                     pa.array(np.full(n, batch.column("q_block")[i].as_py(), dtype=np.int64)),
                     pa.array(np.full(n, batch.column("lane")[i].as_py(), dtype=np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), entries)], ["q_row", "query_id", "q_block", "lane", "top"])
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
                vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query's k highest integer inner products with all other rows.

    Components become floor(scale * x). Candidates are packed in shards and queries in blocks; every block meets every shard
    in one tile: a matrix product, and a partial selection of each query's k best. The short lists are merged in a tree of
    fan-in 16, so no task holds more than 16 lists a query. Ties go to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. A shorter vector
    counts as padded with 0; an empty one scores 0. A row is no candidate of queries with its own id; of repeated rows each is
    a query and a candidate. With fewer than k candidates all are returned, with none the query has no row. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("wanted"))
    shards = blocks(rows.select("vec_id", "vector"), SHARD_ROWS, scale)
    queries = blocks(rows.filter("wanted").select("vec_id", "vector"), QUERY_ROWS, scale)
    lanes = max(1, shards.count())
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes))
    right = shards.select(lane.alias("lane"), *[F.col(n).alias(f"c_{n}") for n in BLOCK_FIELDS])
    left = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"),
                          F.col("block").alias("q_block"), *[F.col(n).alias(f"q_{n}") for n in BLOCK_FIELDS])
    tops = left.join(right, "lane").mapInArrow(
        tile_tops(k), "q_row long, query_id long, q_block long, lane long, top array<struct<less: long, vec_id: long>>")
    key = ["q_block", "q_row", "query_id"]
    while True:
        lanes = -(-lanes // FAN_IN)
        tops = (tops.withColumn("lane", F.expr(f"lane div {FAN_IN}")).groupBy(*key, "lane")
                .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        if lanes == 1:
            break
    return tops.select("query_id", F.posexplode("top").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.less")).alias("score"))
