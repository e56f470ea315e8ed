"""Calendar periods: start, end, label, distance. Weeks start on Monday."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, SparkSession, functions as F

UNITS = ("day", "week", "month", "quarter", "year")
# periods back to "the same period a year ago"
YEAR_BACK = {"day": 365, "week": 52, "month": 12, "quarter": 4, "year": 1}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_DAYS = {"day": 1, "week": 7}


def check_unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unknown period unit {unit!r}; use one of {', '.join(UNITS)}")
    return unit


def period_start(ts: Column, unit: str) -> Column:
    """First day of the period; works on the date, so no time zone is involved."""
    day = ts.cast("date")
    return day if check_unit(unit) == "day" else F.trunc(day, unit)


def shift(start: Column, n: int, unit: str) -> Column:
    """Move a period start by n periods on the calendar."""
    if unit in _DAYS:
        return F.date_add(start, n * _DAYS[unit])
    return F.add_months(start, n * _MONTHS[unit])


def shifted_dates(spark: SparkSession, start: date, by: dict[str, int], unit: str) -> dict[str, date]:
    """Period starts moved on the calendar, as plain dates (one row, no data read)."""
    row = spark.range(1).select(*[shift(F.lit(start), n, unit).alias(k) for k, n in by.items()]).first()
    return row.asDict()


def period_end(start: Column, unit: str) -> Column:
    return F.date_sub(shift(start, 1, check_unit(unit)), 1)


def period_count(first: Column, last: Column, unit: str) -> Column:
    if unit in _DAYS:
        return F.floor(F.date_diff(last, first) / F.lit(_DAYS[unit])) + 1
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return F.floor(months / F.lit(_MONTHS[unit])) + 1


def step(unit: str) -> Column:
    days, months = _DAYS.get(unit), _MONTHS.get(unit)
    return F.expr(f"INTERVAL {days} DAY" if days else f"INTERVAL {months} MONTH")


def period_label(start: Column, unit: str, style: str = "compact") -> Column:
    """compact: 2026-03-30/2026-04-05, 2026Q2; spaced: 2026-03-30 ~ 2026-04-05, 2026 Q2."""
    if unit == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if unit == "week":
        joint = "/" if style == "compact" else " ~ "
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(joint),
                        F.date_format(period_end(start, unit), "yyyy-MM-dd"))
    if unit == "month":
        return F.date_format(start, "yyyy-MM")
    if unit == "quarter":
        joint = "Q" if style == "compact" else " Q"
        return F.concat(F.year(start).cast("string"), F.lit(joint), F.quarter(start).cast("string"))
    return F.year(start).cast("string")
