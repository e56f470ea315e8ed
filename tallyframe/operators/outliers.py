"""IQR outliers: bounds, rows, summaries and treatments.

Bounds come to the driver as a few numbers per column, so the row filters carry literals that reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.functions.stats import sample_kurtosis, sample_skewness
from tallyframe.operators.quantiles import approx_quantiles, exact_quantiles, literal


@dataclass(frozen=True)
class Bounds:
    q1: float | None
    q3: float | None
    factor: float = 1.5

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def low(self) -> float | None:
        return None if self.q1 is None else self.q1 - self.factor * self.iqr

    @property
    def high(self) -> float | None:
        return None if self.q1 is None else self.q3 + self.factor * self.iqr

    def outside(self, value: Column) -> Column:
        """True / false, never NULL: a missing value is not an outlier."""
        if self.q1 is None:
            return F.lit(False)
        return F.coalesce((value < F.lit(self.low)) | (value > F.lit(self.high)), F.lit(False))


def bounds_of(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, Bounds]:
    find = approx_quantiles if approximate else exact_quantiles
    return {c: Bounds(q[0], q[1]) for c, q in find(df, columns, [0.25, 0.75]).items()}


def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, q1, q3, iqr, lower_bound, upper_bound."""
    return df.sparkSession.createDataFrame(
        [(c, b.q1, b.q3, b.iqr, b.low, b.high) for c, b in bounds_of(df, columns).items()],
        "column string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double")


def iqr_outliers(df: DataFrame, column: str, bounds: Bounds | None = None) -> DataFrame:
    bounds = bounds or bounds_of(df, [column])[column]
    if bounds.q1 is None:
        return df.limit(0)
    value = C.as_double(df, column)
    return df.filter((value < bounds.low) | (value > bounds.high))


def outlier_summary(df: DataFrame, columns: list[str], identifiers=(), bounds: dict[str, Bounds] | None = None) -> DataFrame:
    """One row per column: bounds, outlier_count, outlier_pct of the valid values; one counting pass for all."""
    columns = [c for c in columns if c not in set(identifiers)]
    bounds = bounds_of(df, columns) if bounds is None else bounds
    aggs = []
    for i, c in enumerate(columns):
        value = C.as_double(df, c)
        aggs += [F.count(value).alias(f"n{i}"), F.count_if(bounds[c].outside(value)).alias(f"o{i}")]
    return C.to_rows(df.agg(*aggs), [
        {
            "column": F.lit(c), "q1": literal(bounds[c].q1), "q3": literal(bounds[c].q3), "iqr": literal(bounds[c].iqr),
            "lower_bound": literal(bounds[c].low), "upper_bound": literal(bounds[c].high),
            "valid_count": F.col(f"n{i}"), "outlier_count": F.col(f"o{i}"),
            "outlier_pct": C.percent(F.col(f"o{i}"), F.col(f"n{i}")),
        }
        for i, c in enumerate(columns)
    ])


def outlier_context(df: DataFrame, column: str, context: list[str], row_id: str) -> DataFrame:
    """Outlier rows reduced to row id, value and chosen context columns."""
    kept = dict.fromkeys([row_id, column, *[c for c in context if c in df.columns]])
    return iqr_outliers(df, column).select(*[C.quoted(c) for c in kept])


def outlier_export(df: DataFrame, column: str) -> DataFrame:
    bounds = bounds_of(df, [column])[column]
    value = C.as_double(df, column)
    reason = F.when(value < literal(bounds.low), "below lower bound").otherwise("above upper bound")
    return iqr_outliers(df, column, bounds).withColumns({
        "outlier_field": F.lit(column), "outlier_value": value, "lower_bound": literal(bounds.low),
        "upper_bound": literal(bounds.high), "outlier_reason": reason})


def outlier_by_date(df: DataFrame, column: str, date: str) -> DataFrame:
    """day, outlier_count."""
    day = C.quoted(date).cast("date")
    return (iqr_outliers(df, column).filter(day.isNotNull()).groupBy(day.alias("day"))
            .agg(F.count(F.lit(1)).alias("outlier_count")))


def labelled_points(df: DataFrame, column: str, date: str) -> DataFrame:
    """date, value, status normal | outlier."""
    bounds = bounds_of(df, [column])[column]
    value = C.as_double(df, column)
    status = F.when(bounds.outside(value), "outlier").otherwise("normal")
    return df.filter(value.isNotNull() & C.quoted(date).isNotNull()).select(
        C.quoted(date).alias("date"), value.alias("value"), status.alias("status"))


# ---- treatments: DataFrame in, DataFrame out -------------------------------------------------------

def drop_outliers(df: DataFrame, column: str, bounds: Bounds | None = None) -> DataFrame:
    bounds = bounds or bounds_of(df, [column])[column]
    return df.filter(~bounds.outside(C.as_double(df, column)))


def winsorize(df: DataFrame, column: str, bounds: Bounds | None = None) -> DataFrame:
    """Clip to the bounds, as double; NULL stays NULL."""
    bounds = bounds or bounds_of(df, [column])[column]
    value = C.as_double(df, column)
    if bounds.q1 is None:
        return df.withColumn(column, value)
    clipped = F.greatest(F.least(value, F.lit(bounds.high)), F.lit(bounds.low))
    return df.withColumn(column, F.when(value.isNotNull(), clipped))


def outliers_to_median(df: DataFrame, column: str) -> DataFrame:
    q1, median, q3 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    value = C.as_double(df, column)
    return df.withColumn(column, F.when(Bounds(q1, q3).outside(value), literal(median)).otherwise(value))


def outliers_to_quantile(df: DataFrame, column: str, lower_q: float = 0.01, upper_q: float = 0.99) -> DataFrame:
    """Low outliers become the lower quantile, high ones the upper quantile."""
    if not 0 <= lower_q < upper_q <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")
    q1, q3, low, high = exact_quantiles(df, [column], [0.25, 0.75, lower_q, upper_q])[column]
    bounds, value = Bounds(q1, q3), C.as_double(df, column)
    changed = F.when(value < literal(bounds.low), literal(low)).when(value > literal(bounds.high), literal(high))
    return df.withColumn(column, changed.otherwise(value))


def mark_outliers(df: DataFrame, column: str) -> DataFrame:
    bounds = bounds_of(df, [column])[column]
    return df.withColumn(f"is_outlier_{column}", bounds.outside(C.as_double(df, column)))


TREATMENTS = {"drop_rows": drop_outliers, "winsorize": winsorize, "mark": mark_outliers,
              "median": outliers_to_median, "quantile": outliers_to_quantile}
METRICS = ("rows", "outliers", "mean", "median", "max", "min", "std", "skew", "kurtosis")


def _column_metrics(df: DataFrame, column: str, label: str) -> DataFrame:
    value = C.as_double(df, column)
    q1, median, q3 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.count_if(Bounds(q1, q3).outside(value)).cast("double").alias("outliers"),
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_samp(value).alias("std"), sample_skewness(value).alias("skew"),
        sample_kurtosis(value).alias("kurtosis"),
    ).withColumn("median", literal(median))
    return C.to_rows(one, [{"metric": F.lit(m), label: F.bround(F.col(m), 3)} for m in METRICS])


def compare_treatment(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """metric, before, after (3 decimals)."""
    left, right = _column_metrics(before, column, "before"), _column_metrics(after, column, "after")
    return left.join(F.broadcast(right), "metric")  # nine rows a side


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
