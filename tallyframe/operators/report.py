"""The whole exploratory report as long rows, and the flags drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import categories as G, profiling as P
from tallyframe.operators.correlation import correlation_report
from tallyframe.operators.numeric import medians_and_bounds, numeric_summary
from tallyframe.operators.outliers import outlier_summary, union_all

MISSING, CONCENTRATED, OUTLYING, CORRELATED = 0.3, 0.6, 0.05, 0.8
MISSING_LABEL = "<缺失>"


def _long(df: DataFrame, section: str, keys: list[str], metrics: list[str]) -> DataFrame:
    subject = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), subject.alias("subject"), F.inline(pairs))


def report_parts(df: DataFrame, date_columns=()) -> dict[str, DataFrame]:
    """The report's frames: overview, numeric, top_values, categories, correlations, outliers, missing.

    Each has a few rows per column or pair and is fetched once, because both the report and the flags read it again.
    """
    cols = P.data_columns(df)
    numbers = [c for c in cols if C.is_numeric(C.dtype_of(df, c))]
    labels = [c for c in cols if (C.is_text(C.dtype_of(df, c)) or C.is_bool(C.dtype_of(df, c))) and c not in set(date_columns)]
    dates = set(date_columns) | {c for c in cols if C.is_datetime(C.dtype_of(df, c))}
    missing = P.column_profile(df, distinct="none").select(
        "column", F.coalesce(F.try_divide(P.missing_count(), F.col("total")), F.lit(0.0)).alias("missing_rate"))
    missing = P.pinned(missing)
    rows = df.count()
    total = F.lit(rows)
    parts = {
        "overview": df.sparkSession.range(1).select(total.cast("bigint").alias("row_count")).withColumns({
            "column_count": F.lit(len(cols)), "numeric_column_count": F.lit(len(numbers)),
            "categorical_column_count": F.lit(len(labels)), "date_column_count": F.lit(len(dates))}),
        "missing": missing,
    }
    if numbers:
        medians, bounds = medians_and_bounds(df, numbers)
        parts["numeric"] = P.pinned(numeric_summary(df, numbers, None, medians)).join(F.broadcast(missing), "column")  # one row per column
        parts["outliers"] = P.pinned(outlier_summary(df, numbers, bounds=bounds)).select(
            "column", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count",
            F.coalesce(F.try_divide(F.col("outlier_count"), F.col("valid_count")), F.lit(0.0)).alias("outlier_ratio"))
        parts["correlations"] = P.pinned(correlation_report(df, numbers))
    if labels:
        counts = P.value_counts(df, labels)
        shown = counts.withColumn("value", F.coalesce("value", F.lit(MISSING_LABEL))).groupBy("column", "value").agg(
            F.sum("count").alias("count"))
        top = P.pinned(G.top_per_column(shown, 5).withColumn("ratio", F.col("count") / total))
        parts["top_values"] = top
        sizes = counts.groupBy("column").agg(F.count_if(F.col("value").isNotNull()).alias("unique_count"))
        heads = top.groupBy("column").agg(
            F.sum("ratio").alias("top5_ratio"), F.max("ratio").alias("top1_ratio"),
            F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top1_value"))
        parts["categories"] = heads.join(F.broadcast(sizes), "column").join(F.broadcast(missing), "column")  # per column
    return parts


def eda_report(df: DataFrame, date_columns=()) -> DataFrame:
    """section, subject, metric, value."""
    p = report_parts(df, date_columns)
    out = [_long(p["overview"].withColumn("t", F.lit("table")), "overview", ["t"], [
        "row_count", "column_count", "numeric_column_count", "categorical_column_count", "date_column_count"])]
    if "numeric" in p:
        out += [_long(p["numeric"], "numeric", ["column"], ["mean", "median", "std", "min", "max", "missing_rate"]),
                _long(p["outliers"], "outliers", ["column"], ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_ratio"]),
                _long(p["correlations"], "correlation", ["field_a", "field_b"], ["correlation"])]
    if "categories" in p:
        out += [_long(p["categories"], "categorical", ["column"], ["unique_count", "top5_ratio", "top1_ratio", "missing_rate"]),
                _long(p["top_values"], "top_value", ["column", "value"], ["count", "ratio"])]
    return union_all(out)


FLAG_COLUMNS = ("group", "flag", "severity", "subject", "amount")


def _flag(df: DataFrame, group: str, flag: str, severity: str | None, subject: Column, amount: str) -> DataFrame:
    return df.select(F.lit(group).alias("group"), F.lit(flag).alias("flag"), F.lit(severity).cast("string").alias("severity"),
                     subject.alias("subject"), F.col(amount).alias("amount"))


def eda_flags(df: DataFrame, date_columns=()) -> DataFrame:
    """group (insight | warning), flag, severity, subject, amount."""
    p = report_parts(df, date_columns)
    out = [_flag(p["missing"].filter(F.col("missing_rate") > MISSING), "warning", "high_missing_rate", "medium", F.col("column"), "missing_rate")]
    if "categories" in p:
        heavy = p["categories"].filter(F.col("top1_ratio") > CONCENTRATED)
        out += [_flag(heavy, "insight", "high_concentration", None, F.concat_ws("|", "column", "top1_value"), "top1_ratio"),
                _flag(heavy, "warning", "high_concentration", "medium", F.col("column"), "top1_ratio")]
    if "numeric" in p:
        noisy = p["outliers"].filter(F.col("outlier_ratio") > OUTLYING)
        tied = p["correlations"].filter(F.abs("correlation") > CORRELATED)
        pair = F.concat_ws("|", "field_a", "field_b")
        out += [_flag(noisy, "insight", "high_outlier_ratio", None, F.col("column"), "outlier_ratio"),
                _flag(noisy, "warning", "high_outlier_ratio", "medium", F.col("column"), "outlier_ratio"),
                _flag(tied, "insight", "strong_correlation", None, pair, "correlation"),
                _flag(tied, "warning", "strong_correlation", "low", pair, "correlation")]
    return union_all(out)
