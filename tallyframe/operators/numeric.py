"""Numeric distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.functions.stats import sample_kurtosis, sample_skewness
from tallyframe.operators import profiling as P
from tallyframe.operators.outliers import Bounds, iqr_outliers, outlier_summary
from tallyframe.operators.quantiles import exact_quantiles, literal

MIN_VALUES = 5
DISCRETE_VALUES = 30
MIN_BINS, MAX_BINS = 10, 50


def numeric_summary(df: DataFrame, columns: list[str], digits: int | None = 3, medians: dict[str, float | None] | None = None) -> DataFrame:
    """column, mean, median, std, min, max, skew, kurtosis; medians that are known already are not searched again."""
    if medians is None:
        medians = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    lookup = df.sparkSession.createDataFrame([(c, medians[c]) for c in columns], "column string, median double")
    stats = P.numeric_moments(df, columns).join(F.broadcast(lookup), "column")  # one row per column
    names = ("mean", "median", "std", "min", "max", "skew", "kurtosis")
    return stats.select("column", *[(F.bround(n, digits) if digits is not None else F.col(n)).alias(n) for n in names])


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """numeric_summary (unrounded) plus missing_pct and outlier_pct."""
    medians, bounds = medians_and_bounds(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    out = outlier_summary(df, columns, bounds=bounds).select(
        "column", ((total - F.col("valid_count")) / F.nullif(total, F.lit(0)) * 100).alias("missing_pct"), "outlier_pct")
    return numeric_summary(df, columns, None, medians).join(F.broadcast(out), "column")  # one row per column


def medians_and_bounds(df: DataFrame, columns: list[str]) -> tuple[dict[str, float | None], dict[str, Bounds]]:
    """Both from one search for the three quartiles."""
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return {c: q[1] for c, q in found.items()}, {c: Bounds(q[0], q[2]) for c, q in found.items()}


def _finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns as finite doubles, everything else pruned."""
    return df.select(*[C.as_finite(df, c).alias(c) for c in columns])


def _integer_like(v: Column) -> Column:
    return F.coalesce(F.bool_and(F.abs(v - F.rint(v)) <= 1e-9), F.lit(False))


def distribution_type(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distribution_type: discrete when all values are integers and there are at most 30 of them."""
    data = _finite(df, columns)
    one = data.agg(*[_integer_like(C.quoted(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    rows = C.to_rows(one, [{"column": F.lit(c), "w": F.col(f"w{i}")} for i, c in enumerate(columns)])
    return rows.join(F.broadcast(_distinct(data, columns)), "column").select(  # one row per column
        "column", _kind(F.col("w"), F.col("unique_count")).alias("distribution_type"))


def _distinct(data: DataFrame, columns: list[str]) -> DataFrame:
    return P.column_profile(data, columns).select("column", F.col("distinct_count").alias("unique_count"))


def _kind(whole: Column, distinct: Column) -> Column:
    return F.when(whole & (distinct <= DISCRETE_VALUES), "discrete").otherwise("continuous")


def numeric_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: status, type, counts, moments, quartiles, p10..p90, default bin count."""
    data = _finite(df, columns)
    probs = [0.10, 0.25, 0.50, 0.75, 0.90]
    q = exact_quantiles(data, columns, probs)
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        v = C.quoted(c)
        aggs += [F.count(v).alias(f"n{i}"), _integer_like(v).alias(f"w{i}"),
                 F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                 F.max(v).alias(f"max{i}"), sample_skewness(v).alias(f"skew{i}"), sample_kurtosis(v).alias(f"kurtosis{i}")]
    rows = []
    for i, c in enumerate(columns):
        p10, p25, p50, p75, p90 = [literal(x) for x in q[c]]
        rows.append({
            "column": F.lit(c), "whole": F.col(f"w{i}"), "total_count": F.col("total"), "valid_count": F.col(f"n{i}"),
            "excluded_count": F.col("total") - F.col(f"n{i}"), "mean": F.col(f"mean{i}"), "median": p50,
            "std": F.col(f"std{i}"), "min": F.col(f"min{i}"), "q1": p25, "q3": p75, "max": F.col(f"max{i}"),
            "p10": p10, "p90": p90, "skew": F.col(f"skew{i}"), "kurtosis": F.col(f"kurtosis{i}")})
    stats = C.to_rows(data.agg(*aggs), rows).join(F.broadcast(_distinct(data, columns)), "column")  # one row per column
    n, distinct = F.col("valid_count"), F.col("unique_count")
    status = F.when((n > 0) & (distinct == 1), "constant").when(n < MIN_VALUES, "insufficient").otherwise("ok")
    bins = F.when(F.col("distribution_type") == "continuous", _bins(n, F.col("min"), F.col("max"), F.col("q1"), F.col("q3")))
    return stats.withColumns({"status": status, "distribution_type": _kind(F.col("whole"), distinct)}).withColumn(
        "bin_count", bins).drop("whole")


def _bins(n: Column, low: Column, high: Column, q1: Column, q3: Column) -> Column:
    """Freedman-Diaconis width; square root of n when the middle half is flat; kept within 10..50."""
    iqr, spread = q3 - q1, high - low
    width = 2 * iqr * F.pow(n.cast("double"), F.lit(-1.0 / 3.0))
    by_width = F.ceil(F.least(spread / F.nullif(width, F.lit(0.0)), F.lit(float(MAX_BINS))))
    raw = F.when(iqr > 0, F.coalesce(by_width, F.lit(MAX_BINS).cast("bigint"))).otherwise(
        F.ceil(F.sqrt(n.cast("double"))))
    clamped = F.greatest(F.lit(MIN_BINS), F.least(F.lit(MAX_BINS), raw)).cast("int")
    return F.when((n < 2) | (low == high), F.lit(MIN_BINS)).otherwise(clamped)


def histogram_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, bin_count."""
    data = _finite(df, columns)
    q = exact_quantiles(data, columns, [0.25, 0.75])
    one = data.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(C.quoted(c)).alias(f"n{i}"), F.min(C.quoted(c)).alias(f"a{i}"), F.max(C.quoted(c)).alias(f"b{i}"))])
    return C.to_rows(one, [
        {"column": F.lit(c), "bin_count": F.coalesce(_bins(F.col(f"n{i}"), F.col(f"a{i}"), F.col(f"b{i}"),
                                                           literal(q[c][0]), literal(q[c][1])), F.lit(MIN_BINS))}
        for i, c in enumerate(columns)])


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """bin, low, high, count over equally wide bins, empty ones included; only the bins leave the cluster."""
    data = _finite(df, [column])
    n, low, high = data.agg(F.count(C.quoted(column)), F.min(C.quoted(column)), F.max(C.quoted(column))).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, low double, high double, count bigint")
    if bins is None:
        bins = histogram_bins(data, [column]).first()["bin_count"]
    width = (high - low) / bins or 1.0
    bucket = F.least(F.lit(bins - 1), F.floor((C.quoted(column) - F.lit(low)) / F.lit(width)).cast("int"))
    counts = data.filter(C.quoted(column).isNotNull()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
                                     (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"))
    return frame.join(F.broadcast(counts), "bin", "left").select(  # at most ``bins`` rows
        "bin", "low", "high", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def discrete_frequency(df: DataFrame, column: str) -> DataFrame:
    """value, count in ascending order of the value."""
    value = C.as_finite(df, column)
    return df.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(
        F.count(F.lit(1)).alias("count")).orderBy("value")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, q1, median, q3, max, whiskers (last values inside the fences), outlier_count."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, rows = [], []
    for i, c in enumerate(columns):
        v, bounds = C.as_double(df, c), Bounds(q[c][0], q[c][2])
        inside = F.when(~bounds.outside(v), v)
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}"),
                 F.count_if(bounds.outside(v)).alias(f"o{i}")]
        rows.append({"column": F.lit(c), "min": F.col(f"a{i}"), "q1": literal(q[c][0]), "median": literal(q[c][1]),
                     "q3": literal(q[c][2]), "max": F.col(f"b{i}"), "whisker_low": F.col(f"lo{i}"),
                     "whisker_high": F.col(f"hi{i}"), "outlier_count": F.col(f"o{i}")})
    return C.to_rows(df.agg(*aggs), rows)


def box_points(df: DataFrame, column: str) -> DataFrame:
    """The outlier values with how often each occurs."""
    return iqr_outliers(df, column).groupBy(C.as_double(df, column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def distribution_reading(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and label codes: shape, pull of the mean, tail, share of outliers."""
    stats = numeric_profile(df, columns)
    skew, gap = F.col("skew"), F.col("mean") - F.col("median")
    size = F.abs(F.coalesce(skew, F.lit(0.0)))
    shape = (F.when(F.col("mean").isNull(), "no_values").when(size < 0.5, "symmetric")
             .when(size < 1, F.when(skew > 0, "mild_right_skew").otherwise("mild_left_skew"))
             .otherwise(F.when(skew > 0, "strong_right_skew").otherwise("strong_left_skew")))
    scale = F.greatest(F.abs("median"), F.coalesce("std", F.lit(0.0)), F.lit(1e-9))
    pull = F.when(F.abs(gap) / scale >= 0.1, F.when(gap > 0, "mean_pulled_up").otherwise("mean_pulled_down")).otherwise("none")
    return stats.select("column", shape.alias("shape"), pull.alias("pull"),
                        F.coalesce(F.col("kurtosis") > 3, F.lit(False)).alias("heavy_tail"),
                        (F.col("outlier_pct") > 5).alias("many_outliers"))


