"""Two tables as multisets of rows: how often each row occurs on either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C


def _counted(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """_c0, _c1, ... for the columns, _left and _right: names of their own, whatever the tables' columns are called."""
    for df in (left, right):
        if missing := [c for c in columns if c not in df.columns]:
            raise KeyError(f"no such column: {', '.join(missing)}")
    own = [f"_c{i}" for i in range(len(columns))]

    def side(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(*[C.quoted(c).alias(o) for c, o in zip(columns, own)], F.lit(a).alias("_left"), F.lit(b).alias("_right"))

    return side(left, 1, 0).union(side(right, 0, 1)).groupBy(*own).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))


def _named(counts: DataFrame, columns: list[str], **numbers: Column) -> DataFrame:
    if clash := sorted(set(numbers) & set(columns)):
        raise ValueError(f"{', '.join(clash)}: rename these columns first")
    return counts.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], *[v.alias(k) for k, v in numbers.items()])


def _only(a: str, b: str) -> Column:
    return F.greatest(F.col(a) - F.col(b), F.lit(0))


def row_counts(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """columns, n_left, n_right: one row for each different row of either side; missing equals missing.

    One shuffle for both sides; copies collapse before it, so a row that makes up a third of a table is one row per task.
    """
    columns = list(left.columns if columns is None else columns)
    return _named(_counted(left, right, columns), columns, n_left=F.col("_left"), n_right=F.col("_right"))


def rows_changed(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that do not occur equally often, with removed and added: the multiset differences of both directions."""
    columns = list(left.columns if columns is None else columns)
    return _named(_counted(left, right, columns).filter("_left <> _right"), columns, removed=_only("_left", "_right"), added=_only("_right", "_left"))


def rows_common(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of both sides, with common: how often they occur on both (the multiset intersection)."""
    columns = list(left.columns if columns is None else columns)
    return _named(_counted(left, right, columns).filter("_left > 0 AND _right > 0"), columns, common=F.least("_left", "_right"))


def diff_summary(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows_before, rows_after, unchanged, removed, added, different_rows."""
    columns = list(left.columns if columns is None else columns)

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(name)

    return _counted(left, right, columns).agg(
        total(F.col("_left"), "rows_before"), total(F.col("_right"), "rows_after"), total(F.least("_left", "_right"), "unchanged"),
        total(_only("_left", "_right"), "removed"), total(_only("_right", "_left"), "added"),
        F.count_if(F.col("_left") != F.col("_right")).alias("different_rows"))
