"""Subtotals over periods and dimensions from one scan, and sums that move over calendar periods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as day

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import columns as C, periods as D
from tallyframe.operators.business import Fields, biz_metric, dated

TOTAL = "total"


def additive(metric: str, fields: Fields) -> bool:
    """Whether groups of the metric add up: sums and row counts do, distinct counts and means do not."""
    if metric == "orders":
        return fields.order_id is None
    if metric == "customers":
        return fields.customer_id is None
    return metric != "unit_price"


def dimension_rollup(df: DataFrame, date: str, dimensions: Sequence[str], metric: str, fields: Fields, unit: str = "month",
                     sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """period, dimensions, level, metric: one row for each group of each grouping set.

    ``sets`` name "period" and dimensions; the default drops the last name step by step down to the grand total. ``level`` names
    what a row is grouped by ("total" for nothing), which tells a subtotal from a missing dimension value. Rows without a date
    are left out. An additive metric is grouped once in full and only these groups are expanded to the sets; distinct
    counts and means need the rows, once for each set.
    """
    names = ["period", *dimensions]
    sets = [names[:n] for n in range(len(names), -1, -1)] if sets is None else [list(s) for s in sets]
    unknown = {n for s in sets for n in s} - set(names)
    if unknown:
        raise KeyError(f"no such grouping column: {', '.join(sorted(unknown))}")
    if missing := [d for d in dimensions if d not in df.columns]:
        raise KeyError(f"no such dimension: {', '.join(missing)}")
    # names of their own, so that a metric or a dimension may be called like another column
    rows = dated(df, date, unit)
    keys = {"period": F.col("_period"), **{d: C.quoted(d) for d in dimensions}}
    own = {n: f"_g{i}" for i, n in enumerate(names)}
    rows = rows.select("*", *[keys[n].alias(own[n]) for n in names])
    value = biz_metric(rows, metric, fields)
    if additive(metric, fields):
        rows = rows.groupBy(*own.values()).agg(value.alias("_value"))
        value = F.coalesce(F.sum("_value"), F.lit(0)).cast(rows.schema["_value"].dataType)
    grouped = rows.groupingSets([[own[n] for n in s] for s in sets], *own.values()).agg(F.grouping_id().alias("_set"), value.alias("_value"))
    level = F.lit(None).cast("string")
    for s in sets:
        code = sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s)
        level = F.when(F.col("_set") == code, "+".join(n for n in names if n in s) or TOTAL).otherwise(level)
    return grouped.select(D.period_label(F.col(own["period"]), unit).alias("period"), *[F.col(own[d]).alias(d) for d in dimensions],
                          level.alias("level"), F.col("_value").alias(metric))


def moving_metric(df: DataFrame, date: str, metric: str, fields: Fields, unit: str = "month", periods: int = 3,
                  dimension: str | None = None) -> DataFrame:
    """period, dimension (if given), metric, moving_sum, present_periods over the last ``periods`` calendar periods.

    The frame is a range of period numbers, so a period without rows shortens the sum instead of reaching further back. The
    window sees one row for each period and dimension value. Only additive metrics have a moving sum.
    """
    if periods < 1:
        raise ValueError("periods must be at least 1")
    if not additive(metric, fields):
        raise ValueError(f"groups of {metric} do not add up")
    rows = dated(df, date, unit)
    by = [] if dimension is None else [dimension]
    grouped = rows.groupBy("_period", *map(C.quoted, by)).agg(biz_metric(rows, metric, fields).alias(metric))
    origin = day(1970, 1, 5) if unit == "week" else day(1970, 1, 1)  # a Monday
    number = D.period_count(F.lit(origin), F.col("_period"), unit)
    window = Window.partitionBy(*map(C.quoted, by)).orderBy(number).rangeBetween(1 - periods, 0)
    return grouped.select(D.period_label(F.col("_period"), unit).alias("period"), *map(C.quoted, by), C.quoted(metric),
                          F.sum(C.quoted(metric)).over(window).alias("moving_sum"), F.count(F.lit(1)).over(window).alias("present_periods"))
