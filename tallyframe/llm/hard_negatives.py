"""Hard negatives by an inverted multi-index: two codebooks of half vectors, cells visited by bound until windows are certified."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.text import pinned
from tallyframe.llm.topk import products

SAMPLE = 4096  # vectors that the codebooks are fitted on; all vectors are indexed
MOST_CODES = 256  # per half, so at most 65,536 cells
FIRST_CELLS, CELL_GROWTH = 16, 8
BLOCK_ROWS, CHUNK_ANCHORS = 4096, 512
HELD_HITS = 400_000  # hits a task merges before it hands them on
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
HITS = pa.list_(pa.struct([("p", pa.int32()), ("less", pa.int64()), ("vec_id", pa.int64())]))
HITS_SQL = "array<struct<p: int, less: long, vec_id: long>>"


def usable(scale: float):
    """Rows of finite vectors with id and label; components as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            size = np.asarray(pa.compute.list_value_length(vectors).fill_null(0)).astype(np.int64)
            value = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
            owner = np.repeat(np.arange(len(size)), size)
            good = np.asarray(vectors.is_valid()) & np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("label").is_valid())
            good[owner[~np.isfinite(value)]] = False
            value = np.floor(scale * np.where(good[owner], value, 0))
            if (np.bincount(owner, value * value, len(size)) >= 2.0 ** 61).any():
                raise ValueError("a vector is too long for 64-bit inner products: the squares of its scaled components sum to 2^61 or more")
            value, cut = value.astype(np.int32), np.concatenate(([0], np.cumsum(size)))
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(pa.array(keep)) for n in ("vec_id", "label", "wanted")),
                 pa.array([value[cut[i]:cut[i + 1]].tobytes() for i in keep], pa.binary())], ["vec_id", "label", "wanted", "values"])
    return run


def matrix(values: list[bytes], width: int) -> np.ndarray:
    """Rows padded with 0 to `width` components."""
    return np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in values), np.int32).reshape(len(values), width).astype(np.int64)


def fit_codes(x: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Centres of k-means, started from rows far from one another."""
    centres = x[:1].astype(np.float64)
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < codes and near.max() > 0:
        centres = np.vstack((centres, x[int(near.argmax())]))
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


@dataclass
class MultiIndex:
    """Both codebooks, the radius of each code (the longest way from it to a half vector that it stands for), and the cells in use."""

    width: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    parts: dict[int, int] | None = None  # blocks that a cell's rows are dealt to

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.width // 2
        return x[:, :cut], x[:, cut:]

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of the cells in use, upper bounds falling: a heap over pairs of codes, each half sorted
        by its own bound. No row of a cell scores outside its bounds."""
        own, order = [], []
        for x, codes, radii in zip(self.halves(query[None, :].astype(np.float64)), self.codes, self.radii):
            middle, reach = codes @ x[0], np.sqrt((x[0] ** 2).sum()) * radii
            reach = reach + 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding must not cut a row off
            best = np.argsort(-(middle + reach), kind="stable")
            own.append(((middle + reach)[best], (middle - reach)[best]))
            order.append(best)
        (high, low), (high_2, low_2) = own
        heap = [(-(high[0] + high_2[0]), 0, 0)]
        while heap:
            less, i, j = heapq.heappop(heap)
            cell = int(order[0][i]) * MOST_CODES + int(order[1][j])
            if cell in self.parts:
                yield -less, low[i] + low_2[j], cell
            if j + 1 < len(high_2):
                heapq.heappush(heap, (-(high[i] + high_2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(high):
                heapq.heappush(heap, (-(high[i + 1] + high_2[0]), i + 1, 0))


def coded(index: MultiIndex):
    """Adds the cell and both halves' distances to their codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("values").to_pylist(), index.width).astype(np.float64)
            out = []
            for half, codes in zip(index.halves(x), index.codes):
                own = nearest(half, codes)
                out.append((own, np.sqrt(((half - codes[own]) ** 2).sum(axis=1))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(o.astype(np.int32)) for o, _ in out), *(pa.array(r) for _, r in out)],
                [*batch.schema.names, "code_0", "code_1", "far_0", "far_1"])
    return run


def dealt(index: MultiIndex):
    """Adds the part of its cell that a row is dealt to; a large cell has many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            parts = np.array([index.parts[c] for c in cell.tolist()], dtype=np.int64)
            draw = np.asarray(batch.column("draw")) % parts if len(parts) else parts
            yield batch.set_column(batch.schema.get_field_index("draw"), "draw", pa.array(draw))
    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and part become blocks of one cell each, rows by id."""
    held: list[tuple[int, int, bytes]] = []

    def block(key: tuple[int, int]) -> pa.RecordBatch:
        rows = sorted(held)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
             pa.array([[r[2] for r in rows]], pa.list_(pa.binary()))], ["cell", "ids", "labels", "members"])

    now = None
    for batch in batches:
        for cell, part, *row in zip(*(batch.column(n).to_pylist() for n in ("cell", "draw", "vec_id", "label", "values"))):
            if held and (now != (cell, part) or len(held) >= BLOCK_ROWS):
                yield block(now)
            now = (cell, part)
            held.append(tuple(row))
    if held:
        yield block(now)


def requests(index: MultiIndex, first: int, last: int):
    """(cell, anchor_row): cells number first to last of each anchor's order, without those that lie outside all of its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("values").to_pylist(), index.width)
            cells, rows = [], []
            for i, windows in enumerate(batch.column("windows").to_pylist()):
                top = max((w["high"] for w in windows if w["low"] <= w["high"]), default=LOWEST)
                for k, (_, low, cell) in enumerate(index.cells(x[i])):
                    if k >= last:
                        break
                    if k >= first and low <= top:
                        cells.append(cell)
                        rows.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int32()), *(batch.column(n).take(pa.array(rows, pa.int64())) for n in ("anchor_row", "anchor_id", "label", "values", "windows"))],
                ["cell", "anchor_row", "anchor_id", "label", "values", "windows"])
    return run


def tile_hits(width: int, k: int, same: bool):
    """The first k rows of each anchor's windows, merged over the tiles of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def handed() -> pa.RecordBatch:
            rows = pa.array([a for a, _ in held], pa.int64())
            hits = pa.array([[{"p": p, "less": less, "vec_id": v} for less, v in top] for (_, p), top in held.items()], HITS)
            held.clear()
            return pa.RecordBatch.from_arrays([rows, hits], ["anchor_row", "hits"])

        size = 0
        for batch in batches:
            for t in range(batch.num_rows):
                anchors = batch.column("anchors")[t].as_py()
                ids, labels = (np.array(batch.column(n)[t].as_py(), dtype=np.int64) for n in ("ids", "labels"))
                scores = products(matrix([a["values"] for a in anchors], width), matrix(batch.column("members")[t].as_py(), width))
                for a, score in zip(anchors, scores):
                    cand = np.flatnonzero(((labels == a["label"]) == same) & (ids != a["anchor_id"]))
                    cand = cand[np.argsort(-score[cand], kind="stable")]  # rows come by id, so ties do, too
                    less = -score[cand]
                    for p, w in enumerate(a["windows"]):
                        i, j = np.searchsorted(less, -w["high"], "left"), np.searchsorted(less, -w["low"], "right")
                        if i < j:
                            new = list(zip(less[i:min(j, i + k)].tolist(), ids[cand[i:min(j, i + k)]].tolist()))
                            old = held.get((a["anchor_row"], p), [])
                            held[a["anchor_row"], p] = top = sorted(old + new)[:k] if old else new
                            size += len(top) - len(old)
                if size > HELD_HITS:
                    yield handed()
                    size = 0
        if held:
            yield handed()
    return run


def certified(index: MultiIndex, visited: int, k: int):
    """Merges old and new hits; done says that no row of the cells not yet visited can be among the first k of a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("values").to_pylist(), index.width)
            every, done = [], []
            for i, (windows, old, new) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("windows", "hits", "more")))):
                tops: list[list[tuple[int, int]]] = [[] for _ in windows]
                for h in [*(old or ()), *(new or ())]:
                    tops[h["p"]].append((h["less"], h["vec_id"]))
                tops = [sorted(t)[:k] for t in tops]
                bound = next((high for n, (high, _, _) in enumerate(index.cells(x[i])) if n >= visited), float("-inf"))
                done.append(all(w["low"] > w["high"] or bound < w["low"] or len(t) >= k and -t[-1][0] > bound for w, t in zip(windows, tops)))
                every.append([{"p": p, "less": less, "vec_id": v} for p, t in enumerate(tops) for less, v in t])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("anchor_row", "anchor_id", "label", "values", "windows")), pa.array(every, HITS), pa.array(done, pa.bool_())],
                ["anchor_row", "anchor_id", "label", "values", "windows", "hits", "done"])
    return run


ANCHOR = "anchor_row long, anchor_id long, label long, values binary, windows array<struct<low: long, high: long>>"


def first_in_windows(anchors: DataFrame, blocks: DataFrame, index: MultiIndex, chunks: int, k: int, same: bool) -> DataFrame:
    """ANCHOR, hits: for each window of an anchor the k highest scores of rows with its label (same) or another one.

    Each round sends the pending anchors to the next cells of their order, 8 times as many as before; anchors whose windows are
    certified drop out.
    """
    pending, finished, visited = anchors.withColumn("hits", F.lit(None).cast(HITS_SQL)), None, 0
    while True:
        first, visited = visited, FIRST_CELLS if not visited else visited * CELL_GROWTH
        asked = (pending.mapInArrow(requests(index, first, visited), f"cell int, {ANCHOR}")
                 .groupBy("cell", F.pmod(F.xxhash64("anchor_row"), F.lit(chunks)).alias("chunk"))
                 .agg(F.collect_list(F.struct("anchor_row", "anchor_id", "label", "values", "windows")).alias("anchors")))
        tiles = asked.join(blocks, "cell").select("anchors", "ids", "labels", "members")
        found = (tiles.mapInArrow(tile_hits(index.width, k, same), f"anchor_row long, hits {HITS_SQL}")
                 .groupBy("anchor_row").agg(F.flatten(F.collect_list("hits")).alias("more")))
        state = pinned(pending.join(found, "anchor_row", "left").mapInArrow(
            certified(index, visited, k), f"{ANCHOR}, hits {HITS_SQL}, done boolean"))
        ready = state.filter("done").drop("done")
        finished = ready if finished is None else finished.union(ready)
        pending = state.filter("NOT done").drop("done")
        if pending.isEmpty():
            return finished


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                        scale: float = 256.0, label: Column | str = "label", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor, higher ones come first, ties
    by smaller vec_id. An anchor's positives are its first other rows of the same label. For each of them come, by rank, the first
    rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    The index: k-means codebooks of both half vectors, fitted on SAMPLE rows (the smallest hashes of the id), as many codes as the
    fourth root of the rows; a cell is a pair of codes and every row is in one. A code's bound on half a score is its own product
    plus the half anchor's length times the code's radius over all rows. A heap takes the cells of an anchor by falling sum of
    both bounds; it stops when the windows are certified: k rows found that score above the next bound, or the bound below the
    window. Anchors meet cells as matrix products of up to 512 anchors and 4096 rows; a large cell has many such blocks. The
    result is exact whatever the codebooks are; they only set how many cells are visited.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; a vector whose scaled squares
    sum to 2^61 raises an error. A shorter vector counts as padded with 0. A row with the anchor's id is neither positive nor
    negative; of repeated rows each counts. Anchors without a positive or a fitting negative have no row. An empty table gives an
    empty result. Other columns are not read.
    """
    name = F.col(label) if isinstance(label, str) else label
    rows = pinned(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), name.cast("long").alias("label"),
                                 F.coalesce(is_anchor, F.lit(False)).alias("wanted"), F.col(vector).alias("vector"))
                  .mapInArrow(usable(scale), "vec_id long, label long, wanted boolean, values binary"))
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.col("wanted").cast("long")).alias("anchors"), F.max(F.length("values")).alias("bytes")).first()
    n, width = facts["n"], (facts["bytes"] or 0) // 4
    drawn = [r["values"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "values").limit(SAMPLE).select("values").collect()]
    sample = matrix(drawn or [b""], width).astype(np.float64)
    wanted = int(min(MOST_CODES, max(1, round(n ** 0.25))))
    index = MultiIndex(width, tuple(fit_codes(half, wanted) for half in MultiIndex(width, ()).halves(sample)))
    placed = pinned(rows.mapInArrow(coded(index), "vec_id long, label long, wanted boolean, values binary, code_0 int, code_1 int, far_0 double, far_1 double")
                    .withColumn("cell", F.col("code_0") * MOST_CODES + F.col("code_1")))
    cells = placed.groupBy("cell", "code_0", "code_1").agg(F.count("*").alias("n"), F.max("far_0").alias("far_0"), F.max("far_1").alias("far_1")).collect()  # at most 65,536
    index.radii = tuple(np.zeros(len(c)) for c in index.codes)
    for c in cells:
        for half in (0, 1):
            index.radii[half][c[f"code_{half}"]] = max(index.radii[half][c[f"code_{half}"]], c[f"far_{half}"])
    index.parts = {c["cell"]: -(-c["n"] // BLOCK_ROWS) for c in cells}
    blocks = pinned(placed.select("cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("draw"), "vec_id", "label", "values")
                    .mapInArrow(dealt(index), "cell int, draw long, vec_id long, label long, values binary")
                    .repartition("cell", "draw").sortWithinPartitions("cell", "draw")
                    .mapInArrow(packed, "cell int, ids array<long>, labels array<long>, members array<binary>"))
    anchors = pinned(placed.filter("wanted").select(F.monotonically_increasing_id().alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "values"))
    chunks = max(1, -(-(facts["anchors"] or 0) // CHUNK_ANCHORS))
    whole = F.array(F.struct(F.lit(LOWEST + 1).alias("low"), F.lit(HIGHEST).alias("high")))
    near = first_in_windows(anchors.withColumn("windows", whole), blocks, index, chunks, positives, same=True)
    ranges = F.transform("hits", lambda h: F.struct(
        (-hundredth(h["less"] * low)).alias("low"), hundredth(h["less"] * -high).alias("high")))
    chosen = near.select("anchor_row", "anchor_id", "label", "values", ranges.alias("windows"), F.col("hits").alias("positives")).filter("size(positives) > 0")
    chosen = pinned(chosen)
    found = first_in_windows(chosen.drop("positives"), blocks, index, chunks, negatives, same=False)
    hits = found.select("anchor_row", "anchor_id", F.explode("hits").alias("h"))
    given = chosen.select("anchor_row", F.posexplode("positives").alias("p", "positive"))
    ranked = hits.select("anchor_row", "anchor_id", F.col("h.p").alias("p"), F.col("h.less").alias("less"), F.col("h.vec_id").alias("negative_id"))
    lists = ranked.groupBy("anchor_row", "anchor_id", "p").agg(F.array_sort(F.collect_list(F.struct("less", "negative_id"))).alias("list"))
    return (lists.join(given, ["anchor_row", "p"]).select("anchor_id", "positive", F.posexplode("list").alias("place", "hit"))
            .select("anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
                    F.col("hit.negative_id").alias("negative_id"), (-F.col("positive.less")).alias("positive_score"),
                    (-F.col("hit.less")).alias("negative_score")))


def hundredth(x: Column) -> Column:
    """x / 100 rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
