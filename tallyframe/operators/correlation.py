"""Pairwise correlations over rows where both values are finite."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.functions.stats import pair_correlation, pair_count
from tallyframe.operators import profiling as P
from tallyframe.operators.ranking import with_global_order
from tallyframe.session import cut_lineage

METHODS = ("pearson", "spearman")
MIN_ROWS, NORMAL_ROWS, COMPLETE = 5, 20, 0.9999
PAIRS_PER_PASS = 24  # keeps the generated aggregate code within one compiled method
GRAM_ROWS = 4096
PAIR_SCHEMA = "field_a string, field_b string, correlation double, sample_size bigint"


def _check(method: str, threshold: float) -> None:
    if method not in METHODS:
        raise ValueError("method must be pearson or spearman")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")


def usable_columns(df: DataFrame, columns: list[str]) -> tuple[list[str], DataFrame]:
    """(columns fit for correlation, column/reason rows of the others); one pass, one row back."""
    columns = list(dict.fromkeys(columns))
    numeric = [c for c in columns if c in df.columns and C.is_numeric(C.dtype_of(df, c))]
    reasons = {c: ("unknown_column" if c not in df.columns else "not_numeric") for c in columns if c not in numeric}
    if numeric:
        r = df.agg(*[x for i, c in enumerate(numeric) for x in (
            F.count(C.as_finite(df, c)).alias(f"n{i}"),
            (F.min(C.as_finite(df, c)) == F.max(C.as_finite(df, c))).alias(f"k{i}"))]).first()
        for i, c in enumerate(numeric):
            if r[f"n{i}"] == 0:
                reasons[c] = "no_finite_values"
            elif r[f"k{i}"]:
                reasons[c] = "constant"
            elif r[f"n{i}"] < MIN_ROWS:
                reasons[c] = "too_few_values"
    rows = [(c, reasons[c]) for c in columns if c in reasons]
    return [c for c in columns if c not in reasons], df.sparkSession.createDataFrame(rows, "column string, reason string")


def raw_pairs(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """field_a, field_b, correlation (NULL if undefined), sample_size for every pair of columns.

    Pearson: up to PAIRS_PER_PASS pairs are sums of one native aggregate; more are products of matrices, a block of rows at a
    time, so a wide table is read twice (means, products) however many pairs it has. Spearman: see rank_pairs.
    """
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    data = df.select(*[C.as_finite(df, c).alias(c) for c in columns])
    if method == "spearman":
        return rank_pairs(data, columns)
    if len(pairs) > PAIRS_PER_PASS:
        return gram_pairs(data, columns)
    one = data.agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        pair_correlation(C.quoted(a), C.quoted(b)).alias(f"r{i}"), pair_count(C.quoted(a), C.quoted(b)).alias(f"n{i}"))])
    return C.to_rows(one, [
        {"field_a": F.lit(a), "field_b": F.lit(b), "correlation": _clamped(F.col(f"r{i}")), "sample_size": F.col(f"n{i}")}
        for i, (a, b) in enumerate(pairs)])


def _named(sums: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pair (number), n, xy, xx, yy (sums of centred products) with the pair's names and its correlation."""
    names = sums.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, field_a string, field_b string")
    value = F.col("xy") / F.nullif(F.sqrt(F.greatest("xx", F.lit(0.0))) * F.sqrt(F.greatest("yy", F.lit(0.0))), F.lit(0.0))
    known = names.join(sums, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return known.select("field_a", "field_b", _clamped(value).alias("correlation"), F.col("n").alias("sample_size"))


def gram_pairs(data: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson for all pairs of finite or NULL columns from one aggregate: each task sums the products of its rows' matrices.

    With X the values less their column's mean (0 where missing) and M the mask of present values, a pair's sample size and sums
    over rows where both are present are entries of M'M, X'M, (X*X)'M and X'X.
    """
    pairs = list(combinations(columns, 2))
    means = data.agg(*[F.avg(C.quoted(c)) for c in columns]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    left, right = np.triu_indices(len(columns), 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([np.asarray(c.fill_null(float("nan"))) for c in batch.columns])
            for at in range(0, len(x), GRAM_ROWS):
                part = x[at:at + GRAM_ROWS] - centre
                there = ~np.isnan(part)
                part, mask = np.where(there, part, 0.0), there.astype(np.float64)
                new = np.stack((mask.T @ mask, part.T @ mask, mask.T @ part, (part * part).T @ mask, mask.T @ (part * part), part.T @ part))
                total = new if total is None else total + new
        if total is not None:
            sums = total[:, left, right]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left), dtype=np.int32)), *map(pa.array, sums)],
                                             ["pair", "n", "x", "y", "xx", "yy", "xy"])

    sums = data.mapInArrow(products, "pair int, " + ", ".join(f"{c} double" for c in ("n", "x", "y", "xx", "yy", "xy")))
    one = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    # a constant's sum of squares is rounding only, and counts as 0
    spread = {c: F.col(c * 2) - F.col(c) * F.col(c) / n for c in ("x", "y")}
    level = {c: F.when(v > 1e-12 * F.col(c * 2), v).otherwise(0.0) for c, v in spread.items()}
    centred = one.select("pair", F.col("n").cast("bigint").alias("n"), (F.col("xy") - F.col("x") * F.col("y") / n).alias("xy"),
                         level["x"].alias("xx"), level["y"].alias("yy"))
    return _named(centred, pairs)


def _rank_lists(data: DataFrame, columns: list[str]) -> tuple[list[tuple[str, str | None]], dict[tuple[str, str], tuple[int, int]]]:
    """The rank lists that all pairs need, as (column, other column whose missing rows do not count), and the two lists of each pair.

    A pair ranks the rows where both are present. A column's own list serves every partner that misses no row or the
    same rows as the column; partners that miss the same rows share a list. Sets of missing rows are compared by number and a
    64-bit hash of the row ids.
    """
    row = data.agg(F.count(F.lit(1)), *[x for c in columns for x in (
        F.count(C.quoted(c)), F.coalesce(F.bit_xor(F.when(C.quoted(c).isNull(), F.xxhash64("_row"))), F.lit(0)))]).first()
    missing = {c: (row[0] - row[1 + 2 * i], row[2 + 2 * i]) for i, c in enumerate(columns)}
    first_of = {m: c for c, m in reversed(missing.items())}
    numbers: dict[tuple[str, str | None], int] = {}

    def number(a: str, b: str) -> int:
        other = None if missing[b][0] == 0 or missing[a] == missing[b] else first_of[missing[b]]
        return numbers.setdefault((a, other), len(numbers))

    places = {(a, b): (number(a, b), number(b, a)) for a, b in combinations(columns, 2)}
    return list(numbers), places


def rank_pairs(data: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman for all pairs of finite or NULL columns: average ranks, then the correlation of the ranks.

    Every list of ranks is made once and shared by the pairs that need it: one for each column without missing values. All
    lists go through the same shuffles (value counts, one global order, a join back, rows put together again), so their number
    does not grow with the columns; the rows in them do, with the number of lists. Then products per pair as in gram_pairs.
    """
    pairs = list(combinations(columns, 2))
    kept = cut_lineage(data.withColumn("_row", F.monotonically_increasing_id()))
    lists, places = _rank_lists(kept, columns)
    entries = F.array(*[F.when(C.quoted(a).isNotNull() & (C.quoted(b).isNotNull() if b else F.lit(True)),
                               F.struct(F.lit(i).alias("list"), C.quoted(a).alias("value"))) for i, (a, b) in enumerate(lists)])
    long = kept.select("_row", F.inline(F.array_compact(entries)))
    counts = long.groupBy("list", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = cut_lineage(with_global_order(counts, [F.col("list"), F.col("value")], "n", running="upto"))
    size = {r["list"]: r["n"] for r in ordered.groupBy("list").agg(F.sum("n").alias("n")).collect()}  # one row per list
    before, middle, so_far = [], [], 0
    for i in range(len(lists)):
        before.append(so_far)
        middle.append((size.get(i, 0) + 1) / 2)
        so_far += size.get(i, 0)
    shift = F.element_at(F.lit([float(b + m) for b, m in zip(before, middle)]), F.col("list") + 1)
    ranks = ordered.select("list", "value", (F.col("upto") - (F.col("n") - 1) / 2 - shift).alias("rank"))
    rows = long.join(ranks, ["list", "value"]).groupBy("_row").agg(F.collect_list(F.struct("list", "rank")).alias("ranks")).select("ranks")
    ends = np.array([places[p] for p in pairs], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(ends)))
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                column = batch.column("ranks").slice(at, GRAM_ROWS)
                flat = column.flatten()
                owner = np.repeat(np.arange(len(column)), np.asarray(pa.compute.list_value_length(column)))
                x = np.full((len(column), len(lists)), np.nan)
                x[owner, np.asarray(flat.field("list"))] = np.asarray(flat.field("rank"))
                there = ~np.isnan(x)
                x = np.where(there, x, 0.0)
                # lists of a pair hold the same rows, so a product is 0 where either is missing
                full, square, mask = x.T @ x, np.sum(x * x, axis=0), there.T.astype(np.float64) @ there
                total += np.stack((mask[ends[:, 0], ends[:, 1]], full[ends[:, 0], ends[:, 1]], square[ends[:, 0]], square[ends[:, 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ends), dtype=np.int32)), *map(pa.array, total)], ["pair", "n", "xy", "xx", "yy"])

    sums = rows.mapInArrow(products, "pair int, n double, xy double, xx double, yy double")
    one = sums.groupBy("pair").agg(F.sum("n").cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return _named(one, pairs)


def _clamped(r: Column) -> Column:
    """Into [-1, 1]; greatest and least skip NULL, so an undefined value needs the test."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def spearman_ranks(data: DataFrame, column: str, range_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """value, rank: average rank per distinct value from value counts and running sums."""
    counts = data.select(C.quoted(column).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    ordered = with_global_order(counts, [F.col("value")], "n", range_rows, running="upto", at_most=at_most)
    return ordered.select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < 0.3, "weak").when(a < 0.5, "some").when(a < 0.7, "medium").otherwise("strong")


def simple_strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.8, "strong").when(a >= 0.5, "medium").when(a >= 0.3, "weak").otherwise("very_weak")


def correlation_pairs(df: DataFrame, columns: list[str], method: str = "pearson", threshold: float = 0.5) -> DataFrame:
    """Pairs at or above the threshold, strongest first, with labels and the pair's own sample size."""
    _check(method, threshold)
    valid, _ = usable_columns(df, columns)
    r = F.col("correlation")
    found = raw_pairs(df, valid, method).filter((F.col("sample_size") >= MIN_ROWS) & r.isNotNull() & ~F.isnan(r))
    kept = found.filter(F.abs(r) >= threshold)
    return kept.select(
        "field_a", "field_b", r, F.abs(r).alias("absolute"),
        F.when(r > 0, "positive").when(r < 0, "negative").otherwise("none").alias("direction"), strength(r).alias("strength"),
        "sample_size", F.when(F.col("sample_size") < NORMAL_ROWS, "small").otherwise("normal").alias("sample_status"),
        (F.abs(r) >= COMPLETE).alias("near_complete")).orderBy(F.desc("absolute"), "field_a", "field_b")


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """field_a, field_b, correlation, sample_size in long form, both triangles and the diagonal."""
    valid, _ = usable_columns(df, columns)
    upper = raw_pairs(df, valid, method).withColumn(
        "correlation", F.when(F.col("sample_size") >= MIN_ROWS, F.col("correlation")))
    lower = upper.select(F.col("field_b").alias("field_a"), F.col("field_a").alias("field_b"), "correlation", "sample_size")
    if not valid:
        return upper
    one = df.agg(*[F.count(C.as_finite(df, c)).alias(f"n{i}") for i, c in enumerate(valid)])
    diagonal = C.to_rows(one, [{"field_a": F.lit(c), "field_b": F.lit(c), "correlation": F.lit(1.0), "sample_size": F.col(f"n{i}")}
                               for i, c in enumerate(valid)])
    return upper.unionByName(lower).unionByName(diagonal)


def correlation_simple(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson for every pair, 3 decimals, with the simple labels."""
    r = F.col("correlation")
    return raw_pairs(df, columns).filter(r.isNotNull()).select(
        "field_a", "field_b", F.bround(r, 3).alias("correlation"), simple_strength(r).alias("strength"),
        F.when(r >= 0, "positive").otherwise("negative").alias("direction")).orderBy(F.desc(F.abs(r)), "field_a", "field_b")


def correlation_report(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """Pairs whose absolute value is above the threshold, strongest first."""
    r = F.col("correlation")
    return raw_pairs(df, columns).filter(F.abs(r) > threshold).select("field_a", "field_b", r).orderBy(
        F.desc(F.abs(r)), "field_a", "field_b")


def scatter_sample(df: DataFrame, x: str, y: str, max_points: int = 5000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """x, y of at most ``max_points`` rows where both are finite; the same rows for the same seed."""
    if int(max_points) < 1:
        raise ValueError("max_points must be a positive integer")
    both = df.withColumns({"_x": C.as_finite(df, x), "_y": C.as_finite(df, y)}).filter("_x IS NOT NULL AND _y IS NOT NULL")
    return P.sample_rows(both, int(max_points), seed, key).select(F.col("_x").alias("x"), F.col("_y").alias("y"))


def scatter_info(df: DataFrame, x: str, y: str, method: str = "pearson", max_points: int = 5000) -> DataFrame:
    """status, correlation and sample size over all valid rows, and how many points a sample shows."""
    _check(method, 0.0)
    bad = x == y or any(c not in df.columns or not C.is_numeric(C.dtype_of(df, c)) for c in (x, y))
    if bad:
        return df.sparkSession.createDataFrame([("invalid_fields", None, 0, 0, False)],
                                               "status string, correlation double, sample_size bigint, shown bigint, is_sampled boolean")
    one, n = raw_pairs(df, [x, y], method), F.col("sample_size")
    ok = (n >= MIN_ROWS) & F.col("correlation").isNotNull()
    none = F.lit(0).cast("bigint")
    return one.select(F.when(ok, "ok").otherwise("insufficient_data").alias("status"), F.when(ok, F.col("correlation")).alias("correlation"),
                      n, F.when(ok, F.least(n, F.lit(max_points).cast("bigint"))).otherwise(none).alias("shown"),
                      (ok & (n > max_points)).alias("is_sampled"))
