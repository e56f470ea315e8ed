"""Filters, grouped aggregation, sorting and top-k behind the structured analysis query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions import columns as C
from tallyframe.functions.parsing import parse_datetime

AGGREGATIONS = ("sum", "avg", "max", "min", "count", "count_rows", "count_distinct")


@dataclass(frozen=True)
class Intent:
    """What to compute; field names are column names."""

    metric: str | None = None
    dimension: str | None = None
    aggregation: str = "sum"
    filters: tuple[tuple[str, str, object], ...] = ()  # (field, operator, value)
    date_field: str | None = None
    time_range: str | None = None
    as_of: date | None = None
    sort: str | None = None
    top_n: int | None = None


@dataclass
class Answer:
    rows: DataFrame
    summary: DataFrame
    warnings: list[str] = field(default_factory=list)


def filter_eq(df: DataFrame, filters, warnings: list[str] | None = None) -> DataFrame:
    """Equality filters compared as text; unknown fields and other operators are reported and skipped."""
    warnings = [] if warnings is None else warnings
    for name, operator, value in filters:
        if name not in df.columns:
            warnings.append(f"unknown_field:{name}")
        elif operator != "==":
            warnings.append(f"unsupported_operator:{operator}")
        elif C.is_text(C.dtype_of(df, name)):
            df = df.filter(C.quoted(name) == str(value))
        elif isinstance(C.dtype_of(df, name), T.IntegralType) and re.fullmatch(r"0|-?[1-9]\d{0,17}", str(value)):
            df = df.filter(C.quoted(name) == F.lit(int(value)))  # same rows as by text, and the scan can skip
        else:
            df = df.filter(C.quoted(name).cast("string") == str(value))
    return df


def time_bounds(time_range: str, as_of: date) -> tuple[date, date] | None:
    """First and last day of today, yesterday, this/last week, this/last month, last N days."""
    monday, first = as_of - timedelta(days=as_of.weekday()), as_of.replace(day=1)
    before_first = first - timedelta(days=1)
    fixed = {
        "today": (as_of, as_of),
        "yesterday": (as_of - timedelta(days=1),) * 2,
        "this_week": (monday, as_of),
        "last_week": (monday - timedelta(days=7), monday - timedelta(days=1)),
        "this_month": (first, as_of),
        "last_month": (before_first.replace(day=1), before_first),
    }
    if time_range in fixed:
        return fixed[time_range]
    days = re.fullmatch(r"last_(\d+)_days", time_range or "")
    return (as_of - timedelta(days=max(int(days[1]) - 1, 0)), as_of) if days else None


def filter_time_range(df: DataFrame, date_field: str, time_range: str, as_of: date,
                      warnings: list[str] | None = None) -> DataFrame:
    """Whole calendar days, both ends included. The bounds are literals, so they reach the scan."""
    bounds = time_bounds(time_range, as_of)
    if bounds is None:
        if warnings is not None:
            warnings.append(f"unsupported_time_range:{time_range}")
        return df
    ts = parse_datetime(df, date_field)
    return df.filter((ts >= F.lit(bounds[0]).cast("timestamp_ntz"))
                     & (ts < F.lit(bounds[1] + timedelta(days=1)).cast("timestamp_ntz")))


def filter_time_slice(df: DataFrame, date_field: str, year: int | None = None, quarter: int | None = None,
                      month: int | None = None) -> DataFrame:
    """Any mix of year, quarter, month; rows without a date are left out. The year is a range the scan can use."""
    ts = parse_datetime(df, date_field)
    test = ts.isNotNull()
    if year is not None:
        test = test & (ts >= F.lit(date(year, 1, 1)).cast("timestamp_ntz")) & (
            ts < F.lit(date(year + 1, 1, 1)).cast("timestamp_ntz"))
    if quarter is not None:
        test = test & (F.quarter(ts) == quarter)
    if month is not None:
        test = test & (F.month(ts) == month)
    return df.filter(test)


def filter_recent_months(df: DataFrame, date_field: str, months: int) -> DataFrame:
    """Rows from (latest date - (months - 1) months) on, time of day kept."""
    ts = parse_datetime(df, date_field)
    latest = df.agg(F.max(ts) - F.make_ym_interval(F.lit(0), F.lit(max(1, int(months)) - 1))).first()[0]  # a literal reaches the scan
    return df.filter(ts >= F.lit(latest).cast("timestamp_ntz"))


def normal_aggregation(name: str | None) -> str:
    low = str(name or "").strip().lower()
    low = "avg" if low == "mean" else low
    return low if low in AGGREGATIONS else "sum"


def aggregate_column(df: DataFrame, metric: str | None, aggregation: str, empty_sum_is_zero: bool = True) -> Column:
    """One aggregate expression; text metrics are read as numbers, a sum of nothing is 0."""
    kind = normal_aggregation(aggregation)
    if kind == "count_rows" or (kind == "count" and not metric):
        return F.count(F.lit(1))
    if not metric or metric not in df.columns:
        raise ValueError(f"{kind} needs an existing metric column, got {metric!r}")
    if kind == "count":
        return F.count(C.present(df, metric))
    if kind == "count_distinct":
        return F.count_distinct(C.present(df, metric))
    number = C.as_number(df, metric)
    if kind == "sum":
        total = F.sum(number)
        return F.coalesce(total, F.lit(0)) if empty_sum_is_zero else total
    return {"avg": F.avg, "max": F.max, "min": F.min}[kind](number)


def aggregate(df: DataFrame, metric: str | None, aggregation: str, dimension: str | None = None,
              label: str = "value") -> DataFrame:
    """Scalar (one row) or one row per dimension value, the missing value being a group of its own."""
    column = aggregate_column(df, metric, aggregation).alias(label)
    if dimension is None:
        return df.agg(column)
    if dimension not in df.columns:
        raise ValueError(f"no such dimension column: {dimension}")
    return df.groupBy(C.quoted(dimension)).agg(column)


def sort_limit(df: DataFrame, value: str, sort: str | None, top_n: int | None, tie: list[str] = ()) -> DataFrame:
    """Order by value (then by the tie-break columns) and keep the first N; one take-ordered step, no full sort."""
    if sort in ("asc", "desc"):
        key = C.quoted(value).asc_nulls_last() if sort == "asc" else C.quoted(value).desc_nulls_last()
        df = df.orderBy(key, *tie)
    return df.limit(int(top_n)) if top_n else df


def analysis_query(df: DataFrame, intent: Intent) -> Answer:
    """time filter -> filters -> aggregate -> sort -> limit; an empty selection is a success with no rows."""
    warnings: list[str] = []
    kept = df
    if intent.time_range:
        if intent.date_field and intent.as_of:
            kept = filter_time_range(kept, intent.date_field, intent.time_range, intent.as_of, warnings)
        else:
            warnings.append(f"no_date_field:{intent.time_range}")
    kept = filter_eq(kept, intent.filters, warnings)
    dimension = intent.dimension if intent.dimension in df.columns else None
    if intent.dimension and dimension is None:
        warnings.append(f"unknown_dimension:{intent.dimension}")
    result = aggregate(kept, intent.metric, intent.aggregation, dimension)
    if dimension is None:  # nothing selected gives no row, as with a dimension
        result = result.filter(kept.limit(1).exists())
    result = sort_limit(result, "value", intent.sort, intent.top_n, [dimension] if dimension else [])
    summary = df.agg(F.count(F.lit(1)).alias("original_rows")).withColumns({
        "filtered_rows": kept.agg(F.count(F.lit(1))).scalar(),
        "result_rows": result.agg(F.count(F.lit(1))).scalar(),
        "warnings": F.lit(";".join(warnings)),
    })
    return Answer(result, summary, warnings)


def year_topn_query(df: DataFrame, category: str, value: str | None, aggregation: str, top_n: int,
                    date_field: str | None = None, year: int | None = None) -> DataFrame:
    """Optional year, group by category (missing kept), N largest."""
    if date_field and year is not None:
        df = filter_time_slice(df, date_field, year=year)
    kind = "count_rows" if aggregation == "count" else aggregation
    return sort_limit(aggregate(df, value, kind, category), "value", "desc", top_n, [category])


def category_topn(df: DataFrame, column: str, top_n: int) -> DataFrame:
    """category, count, share_pct of the non-missing rows."""
    counts = df.select(C.present(df, column).cast("string").alias("category")).filter("category IS NOT NULL").groupBy(
        "category").agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(C.present(df, column))).scalar()
    top = counts.orderBy(F.desc("count"), "category").limit(top_n)
    return top.withColumn("share_pct", C.percent(F.col("count"), total))


def trend(df: DataFrame, date_field: str, value: str, aggregation: str = "sum") -> DataFrame:
    """date, value: aggregated per distinct date, rows missing either are left out."""
    ts = parse_datetime(df, date_field)
    kept = df.filter(ts.isNotNull() & C.present(df, value).isNotNull())
    return kept.groupBy(ts.alias("date")).agg(aggregate_column(kept, value, aggregation).alias("value"))
