"""Data-quality measurement: missing values, duplicates, scores, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C, names as N
from tallyframe.operators import profiling as P
from tallyframe.operators.outliers import bounds_of, outlier_summary, union_all
from tallyframe.operators.roles import parse_share


def missing_summary(df: DataFrame) -> DataFrame:
    """column, dtype, missing_count, missing_pct, recommendation; most missing first."""
    cols = P.data_columns(df)
    named = [c for c in cols if N.has_hint(c, N.DATE_NAME_HINTS)]
    prof = P.column_profile(df, distinct="none", dates=named)
    ratio = F.coalesce(F.try_divide(P.missing_count(), F.col("total")), F.lit(0.0))
    hinted = F.col("column").isin(named) if named else F.lit(False)
    date_like = (F.col("family") == "datetime") | (hinted & (parse_share() >= 0.8))
    advice = (
        F.when(ratio >= 0.8, "drop_column")
        .when(ratio >= 0.3, "fill_carefully")
        .when(ratio == 0, "none")
        .when(date_like, "do_not_fill")
        .when(F.col("family") == "numeric", "mean_or_median")
        .otherwise("mode")
    )
    return prof.select("column", "dtype", P.missing_count().alias("missing_count"),
                       P.missing_percent().alias("missing_pct"), advice.alias("recommendation")
                       ).orderBy(F.desc("missing_pct"), "column")


def missing_rows_preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """First n rows (by the given order) that miss any value."""
    return df.filter(C.any_missing(df, P.data_columns(df))).orderBy(*order).limit(n)


def copy_groups(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies; copies collapse before the shuffle, NULLs match."""
    columns = P.data_columns(df)
    return df.groupBy(*[P.comparable(df, c).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Extra rows (first copy kept), rows in duplicate groups, and both ratios in percent."""
    return copy_groups(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("group_rows"),
    ).select("total_rows", "extra_rows", "group_rows",
             C.percent(F.col("extra_rows"), F.col("total_rows")).alias("extra_ratio_pct"),
             C.percent(F.col("group_rows"), F.col("total_rows")).alias("group_ratio_pct"))


def duplicate_preview(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """First n rows that belong to duplicate groups.

    At most n groups (in order) can appear, and each shows at most n copies, so nothing larger than n*n rows
    is expanded whatever the size of a group.
    """
    groups = copy_groups(df).filter("copies > 1").orderBy(*order).limit(n)
    shown = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(n)).cast("int")))
    return groups.withColumn("_copy", shown).orderBy(*order, "_copy").limit(n).drop("_copy", "copies")


def _counts(df: DataFrame, numeric: list[str], outlier_columns: list[str]) -> DataFrame:
    """One row: rows, missing, extra rows, numeric values, outliers."""
    cols = P.data_columns(df)
    bounds = bounds_of(df, outlier_columns)
    missing = sum((F.count_if(P.comparable(df, c).isNull()) for c in cols), F.lit(0))
    values = sum((F.count(C.present(df, c)) for c in numeric), F.lit(0))
    out = sum((F.count_if(bounds[c].outside(C.as_double(df, c))) for c in outlier_columns), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("bigint").alias("missing"),
                 values.cast("bigint").alias("values"), out.cast("bigint").alias("outliers"))
    extra = copy_groups(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra"))
    return one.withColumn("extra", extra.scalar())


def _capped(limit: int, points: Column) -> Column:
    return F.least(F.lit(limit).cast("bigint"), points.cast("bigint"))


def _percent_points(part: Column, whole: Column) -> Column:
    return F.bround(part / F.greatest(whole, F.lit(1)) * 100, 0)


def quality_score_v1(df: DataFrame, invalid: list[str], numeric: list[str], identifiers=()) -> DataFrame:
    """score, stars and the counts behind them; missing 30, duplicates 20, invalid 25, outliers 25 points."""
    cells = F.col("rows") * len(P.data_columns(df))
    score = 100 - (
        _capped(30, _percent_points(F.col("missing"), cells))
        + _capped(20, _percent_points(F.col("extra"), F.col("rows")))
        + F.lit(min(25, 5 * len(invalid)))
        + _capped(25, _percent_points(F.col("outliers"), F.col("values"))))
    return _scored(_counts(df, numeric, numeric), score, len(invalid), len(identifiers))


def quality_score_v2(df: DataFrame, identifiers: list[str], invalid: list[str], measures: list[str]) -> DataFrame:
    """Same idea with identifiers: missing 30, duplicates 20, ids 15, invalid 20, outliers 15 points."""
    cells = F.col("rows") * len(P.data_columns(df))
    score = 100 - (
        _capped(30, _percent_points(F.col("missing"), cells))
        + _capped(20, _percent_points(F.col("extra"), F.col("rows")))
        + F.lit(min(15, 3 * len(identifiers)))
        + F.lit(min(20, 5 * len(invalid)))
        + _capped(15, _percent_points(F.col("outliers"), F.col("values"))))
    return _scored(_counts(df, measures, measures), score, len(invalid), len(identifiers))


def _scored(counts: DataFrame, score: Column, invalid: int, identifiers: int) -> DataFrame:
    final = F.greatest(F.lit(0).cast("bigint"), score.cast("bigint"))
    return counts.select(
        final.alias("score"), F.bround(final / 20, 0).cast("bigint").alias("stars"),
        F.col("missing").alias("missing_values"), F.col("extra").alias("duplicate_rows"),
        F.lit(identifiers).cast("bigint").alias("identifier_columns"),
        F.lit(invalid).cast("bigint").alias("invalid_columns"), F.col("outliers").alias("outlier_count"))


def repair_suggestions(df: DataFrame, identifiers: list[str], invalid: list[str], measures: list[str],
                       legacy: bool = False) -> DataFrame:
    """finding, column, severity, action, handle_at; one row per finding.

    ``legacy`` does not repeat an invalid column that is already reported as mostly missing.
    """
    spark = df.sparkSession
    high = P.column_profile(df, distinct="none").filter(
        F.coalesce(F.try_divide(P.missing_count(), F.col("total")), F.lit(0.0)) >= 0.8).select("column")

    def finding(rows: DataFrame, kind: str, severity: str, action: str, place: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("finding"), "column", F.lit(severity).alias("severity"),
                           F.lit(action).alias("action"), F.lit(place).alias("handle_at"))

    def named(columns: list[str]) -> DataFrame:
        return spark.createDataFrame([(c,) for c in columns], "column string")

    repeated = copy_groups(df).filter("copies > 1").limit(1).select(F.lit("*").alias("column"))
    noisy = outlier_summary(df, measures).filter("outlier_count > 0") if measures else named([])
    bad = named(invalid)
    if legacy:
        bad = bad.join(F.broadcast(high), "column", "left_anti")  # one row per column
    return union_all([
        finding(high, "high_missing", "high", "drop_or_refetch", "missing"),
        finding(repeated, "duplicate_rows", "medium", "drop_duplicates", "duplicates"),
        finding(named(identifiers), "identifier", "low", "keep_out_of_statistics", "identifiers"),
        finding(noisy, "outliers", "medium", "review_rows", "outliers"),
        finding(bad, "invalid_column", "high", "confirm_and_drop", "missing"),
    ])


def quality_sheet(df: DataFrame) -> DataFrame:
    """item, value: rows, columns, missing total, duplicate rows, and each column that misses values."""
    prof = P.column_profile(df, distinct="none")
    info = P.basic_info(df)
    totals = C.to_rows(
        info.withColumn("missing", prof.agg(F.sum(P.missing_count())).scalar()),
        [{"item": F.lit(k), "value": F.col(v)} for k, v in (
            ("rows", "row_count"), ("columns", "column_count"), ("missing_total", "missing"),
            ("duplicate_rows", "duplicate_rows"))])
    per_column = prof.filter(P.missing_count() > 0).select(
        F.concat(F.lit("missing:"), F.col("column")).alias("item"), P.missing_count().alias("value"))
    return totals.unionByName(per_column)
