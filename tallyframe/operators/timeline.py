"""Counts over natural periods with the empty ones filled in."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C, periods as D
from tallyframe.functions.parsing import parse_datetime
from tallyframe.operators.ranking import with_global_order

DENSE_PERIODS = 400  # more than a chart can show: the status says so, the rows come all the same


def granularity(first: Column, last: Column) -> Column:
    """day up to 90 days, week up to 2 years, month up to 8 years, else year."""
    return (F.when(F.date_diff(last, first) + 1 <= 90, "day")
            .when(last <= F.add_months(first, 24), "week")
            .when(last <= F.add_months(first, 96), "month").otherwise("year"))


def time_granularity(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, start_date, end_date, granularity."""
    one = df.agg(*[f(parse_datetime(df, c)).cast("date").alias(f"{k}{i}") for i, c in enumerate(columns)
                   for k, f in (("a", F.min), ("b", F.max))])
    return C.to_rows(one, [{"column": F.lit(c), "start_date": F.col(f"a{i}"), "end_date": F.col(f"b{i}"),
                            "granularity": F.when(F.col(f"a{i}").isNotNull(), granularity(F.col(f"a{i}"), F.col(f"b{i}")))}
                           for i, c in enumerate(columns)])


def period_bounds(df: DataFrame, column: str, unit: str) -> DataFrame:
    """period_start, period_end, label per period present in the data."""
    day = parse_datetime(df, column)
    return df.filter(day.isNotNull()).select(D.period_start(day, unit).alias("period_start")).distinct().select(
        "period_start", D.period_end(F.col("period_start"), unit).alias("period_end"),
        D.period_label(F.col("period_start"), unit, "spaced").alias("label"))


@dataclass(frozen=True)
class TimeSpan:
    """One-row facts read first; they decide the unit and whether the periods are listed at all."""

    total: int
    valid: int
    active_dates: int
    first: date | None
    last: date | None
    recommended: str
    unit: str
    first_period: date | None
    last_period: date | None
    period_count: int

    @property
    def status(self) -> str:
        if not self.valid:
            return "no_valid_dates"
        if self.period_count > DENSE_PERIODS:
            return "too_dense"
        return "single_date" if self.active_dates == 1 else "ok"


def read_span(df: DataFrame, column: str, unit: str | None = None) -> TimeSpan:
    if unit is not None:
        D.check_unit(unit)
    day = parse_datetime(df, column).cast("date")
    one = df.agg(F.count(F.lit(1)).alias("total"), F.count(day).alias("valid"), F.count_distinct(day).alias("active"),
                 F.min(day).alias("a"), F.max(day).alias("b"))
    one = one.withColumn("rec", F.when(F.col("a").isNull(), "day").otherwise(granularity(F.col("a"), F.col("b"))))
    chosen = F.lit(unit) if unit else F.col("rec")
    pick = lambda make: F.coalesce(*[F.when(F.col("u") == u, make(u)) for u in D.UNITS])
    r = one.withColumn("u", chosen).withColumns({
        "p": pick(lambda u: D.period_start(F.col("a"), u)), "q": pick(lambda u: D.period_start(F.col("b"), u)),
    }).withColumn("n", F.coalesce(pick(lambda u: D.period_count(F.col("p"), F.col("q"), u)), F.lit(0))).first()
    return TimeSpan(r["total"], r["valid"], r["active"], r["a"], r["b"], r["rec"], r["u"], r["p"], r["q"], int(r["n"]))


ROWS_SCHEMA = "period_start date, period_end date, period_label string, count bigint, ratio double"


def time_distribution(df: DataFrame, column: str, unit: str | None = None, span: TimeSpan | None = None) -> DataFrame:
    """One row per period, zeros included; no rows without dates."""
    span = span or read_span(df, column, unit)
    if span.status == "no_valid_dates":
        return df.sparkSession.createDataFrame([], ROWS_SCHEMA)
    day = parse_datetime(df, column)
    counts = df.filter(day.isNotNull()).groupBy(D.period_start(day, span.unit).alias("period_start")).agg(
        F.count(F.lit(1)).alias("count"))
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(span.first_period), F.lit(span.last_period), D.step(span.unit))).alias("period_start"))
    filled = calendar.join(counts, "period_start", "left")
    n = F.coalesce(F.col("count"), F.lit(0).cast("bigint"))
    return filled.select("period_start", D.period_end(F.col("period_start"), span.unit).alias("period_end"),
                         D.period_label(F.col("period_start"), span.unit, "spaced").alias("period_label"),
                         n.alias("count"), (n / F.lit(span.valid)).alias("ratio"))


def time_summary(df: DataFrame, column: str, unit: str | None = None) -> DataFrame:
    """One row: status, counts, span, units, active and empty periods, peak (earliest on ties)."""
    span = read_span(df, column, unit)
    day = parse_datetime(df, column)
    per = df.filter(day.isNotNull()).groupBy(D.period_start(day, span.unit).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    peak = F.max_by(F.col("p"), F.struct("n", -F.unix_date("p")))
    return per.agg(F.count(F.lit(1)).alias("active"), peak.alias("peak"), F.coalesce(F.max("n"), F.lit(0)).alias("peak_count")).select(
        F.lit(span.status).alias("status"), F.lit(span.total).cast("bigint").alias("total_count"),
        F.lit(span.valid).cast("bigint").alias("valid_count"), F.lit(span.total - span.valid).cast("bigint").alias("excluded_count"),
        F.lit(span.first).cast("date").alias("start_date"), F.lit(span.last).cast("date").alias("end_date"),
        F.lit((span.last - span.first).days + 1 if span.first else 0).alias("calendar_span_days"),
        F.lit(span.active_dates).cast("bigint").alias("active_date_count"), F.lit(span.recommended).alias("recommended"),
        F.lit(span.unit).alias("selected"), F.lit(span.period_count).cast("bigint").alias("period_count"),
        F.col("active").alias("active_period_count"),
        (F.lit(span.period_count) - F.col("active")).cast("bigint").alias("zero_period_count"),
        D.period_label(F.col("peak"), span.unit, "spaced").alias("peak_period"), "peak_count")


def zero_ranges(rows: DataFrame, top: int = 10) -> DataFrame:
    """Runs of consecutive empty periods, longest first; empty periods with as many active ones before them are one run."""
    islands = with_global_order(rows.withColumn("_active", (F.col("count") > 0).cast("bigint")), [F.col("period_start")], "_active",
                                position="_i", running="_g").filter("count = 0")
    return islands.groupBy("_g").agg(
        F.min_by("period_label", "period_start").alias("start_label"), F.max_by("period_label", "period_start").alias("end_label"),
        F.min("period_start").alias("start_date"), F.max("period_end").alias("end_date"),
        F.count(F.lit(1)).alias("period_count")).drop("_g").orderBy(F.desc("period_count"), "start_date").limit(top)
