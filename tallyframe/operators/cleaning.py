"""Cleaning steps, each a DataFrame to a DataFrame. Fill values are scalar subqueries: one row by definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import profiling as P
from tallyframe.operators.quality import copy_groups
from tallyframe.operators.quantiles import exact_quantiles, literal


def _check(df: DataFrame, columns) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"no such column: {', '.join(absent)}")


def _check_numeric(df: DataFrame, column: str, what: str) -> None:
    _check(df, [column])
    if not (C.is_numeric(C.dtype_of(df, column)) or C.is_bool(C.dtype_of(df, column))):
        raise ValueError(f"{what} needs a numeric column, {column} is {C.dtype_of(df, column).simpleString()}")


def drop_missing_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    _check(df, columns or [])
    return df.filter(~C.any_missing(df, columns or P.data_columns(df)))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def high_missing_columns(df: DataFrame, threshold: float = 0.8) -> list[str]:
    prof = P.column_profile(df, distinct="none")
    hit = F.try_divide(P.missing_count(), F.col("total")) >= threshold
    return [r["column"] for r in prof.filter(hit).select("column").collect()]  # one row per column


def drop_high_missing(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return drop_columns(df, high_missing_columns(df, threshold))


def _filled(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(C.present(df, column), value))


def fill_zero(df: DataFrame, column: str) -> DataFrame:
    _check_numeric(df, column, "fill_zero")
    return _filled(df, column, F.lit(0).cast(C.dtype_of(df, column)))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    _check_numeric(df, column, "fill_mean")
    mean = df.agg(F.avg(C.as_double(df, column))).scalar()
    return df.withColumn(column, F.coalesce(C.as_double(df, column), mean))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    _check_numeric(df, column, "fill_median")
    median = exact_quantiles(df, [column], [0.5])[column][0]
    return df.withColumn(column, F.coalesce(C.as_double(df, column), literal(median)))


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """One row with the smallest of the most frequent values; found by groups, not by one value map."""
    counted = df.select(C.present(df, column).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "v").limit(1).select("v")


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    _check(df, [column])
    return _filled(df, column, mode_of(df, column).scalar())


def fill_custom(df: DataFrame, column: str, value) -> DataFrame:
    """Fill with a constant; a text value in a non-text column makes the column text."""
    _check(df, [column])
    dtype = C.dtype_of(df, column)
    if isinstance(value, str) and not C.is_text(dtype):
        return df.withColumn(column, F.coalesce(C.present(df, column).cast("string"), F.lit(value)))
    return _filled(df, column, F.lit(value) if C.is_text(dtype) else F.lit(value).cast(
        "double" if isinstance(value, float) else dtype))


def fill_unknown(df: DataFrame, column: str, label: str = "未知") -> DataFrame:
    return fill_custom(df, column, label)


FILLS = {"zero": fill_zero, "mean": fill_mean, "median": fill_median, "mode": fill_mode, "unknown": fill_unknown}


def fill_missing(df: DataFrame, column: str, method: str, custom_value="") -> DataFrame:
    if method == "custom":
        return fill_custom(df, column, custom_value)
    if method not in FILLS:
        raise ValueError(f"unknown fill method {method!r}")
    return FILLS[method](df, column)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first of full-row copies; with a row id, the copy with the lowest id.

    Copies collapse inside each task before the shuffle, so a group holding a third of the rows costs nothing.
    """
    columns = P.data_columns(df)
    if P.ROW_ID not in df.columns:
        return df.dropDuplicates(columns)
    return df.groupBy(*columns).agg(F.min(P.ROW_ID).alias(P.ROW_ID)).select(*df.columns)


def drop_rows_by_id(df: DataFrame, ids: DataFrame | list, key: str = P.ROW_ID) -> DataFrame:
    """Delete rows by their key; a list typed by a user is small, a frame may be any size."""
    if not isinstance(ids, DataFrame):
        ids = list(dict.fromkeys(ids))
        return df.filter(~C.quoted(key).isin(ids)) if ids else df
    return df.join(ids.select(key).distinct(), key, "left_anti")


def log1p(df: DataFrame, column: str) -> DataFrame:
    """Add <column>_log1p; refuses values below -1."""
    _check(df, [column])
    value = C.as_double(df, column)
    lowest = df.agg(F.min(value)).first()[0]
    if lowest is not None and lowest < -1:
        raise ValueError(f"log1p needs values >= -1, {column} goes down to {lowest}")
    return df.withColumn(f"{column}_log1p", F.log1p(value))


def equal_width_bins(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """Add <column>_bin, 1..bins: right-closed, equally wide over [min, max]; a constant goes to bin 1."""
    _check(df, [column])
    value = C.as_double(df, column)
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e")).scalar()
    width = F.nullif((ends["hi"] - ends["lo"]) / bins, F.lit(0.0))
    inner = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((value - ends["lo"]) / width).cast("int")))
    return df.withColumn(f"{column}_bin", F.when(value.isNotNull(), F.coalesce(inner, F.lit(1))))


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after: rows, columns, missing values, duplicate rows. One scan and one shuffle a side: all four are sums over
    the groups of equal rows."""
    def sheet(df: DataFrame, label: str) -> DataFrame:
        cols = P.data_columns(df)
        missing = sum((C.quoted(c).isNull().cast("bigint") for c in cols), F.lit(0))
        one = copy_groups(df).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(m) for m, v in (
            ("rows", F.col("copies")), ("missing_values", F.col("copies") * missing), ("duplicate_rows", F.col("copies") - 1))])
        one = one.withColumn("columns", F.lit(len(cols)).cast("bigint"))
        return C.to_rows(one, [{"metric": F.lit(m), label: F.col(m)} for m in ("rows", "columns", "missing_values", "duplicate_rows")])

    return sheet(before, "before").join(F.broadcast(sheet(after, "after")), "metric")  # four rows a side
