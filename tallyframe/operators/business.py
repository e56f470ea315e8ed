"""Business metrics over periods and dimensions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions import columns as C, periods as D
from tallyframe.functions.growth import growth_fraction, growth_percent, share_percent
from tallyframe.functions.parsing import parse_datetime
from tallyframe.operators.query import filter_recent_months
from tallyframe.operators.ranking import with_global_order

METRICS = ("amount", "orders", "customers", "unit_price")
BROADCAST_TOP = 10_000  # a longer top list joins without a broadcast hint


@dataclass(frozen=True)
class Fields:
    """Which columns play which part."""

    date: str | None = None
    amount: str | None = None
    order_id: str | None = None
    customer_id: str | None = None
    customer_count: str | None = None
    unit_price: str | None = None
    dimensions: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()


def metric_options(fields: Fields) -> list[str]:
    options = ["amount"] if fields.amount else []
    options.append("orders")
    if fields.customer_id or fields.customer_count:
        options.append("customers")
    if fields.unit_price or fields.amount:
        options.append("unit_price")
    own = {fields.amount, fields.customer_count, fields.unit_price}
    return options + [m for m in fields.metrics if m not in options and m not in own]


def _sum(df: DataFrame, column: str | None) -> Column:
    return F.coalesce(F.sum(C.as_double(df, column)), F.lit(0.0)) if column else F.lit(0.0)


def _orders(fields: Fields) -> Column:
    return F.count_distinct(C.quoted(fields.order_id)) if fields.order_id else F.count(F.lit(1))


def biz_metric(df: DataFrame, metric: str, fields: Fields) -> Column:
    """The metric as one aggregate column, for grouped and ungrouped use."""
    if metric == "amount":
        return _sum(df, fields.amount)
    if metric == "orders":
        return _orders(fields)
    if metric == "customers":
        return F.count_distinct(C.quoted(fields.customer_id)) if fields.customer_id else _sum(df, fields.customer_count)
    if metric == "unit_price":
        if fields.unit_price:
            return F.avg(C.as_double(df, fields.unit_price))
        return F.coalesce(_sum(df, fields.amount) / F.nullif(_orders(fields), F.lit(0)), F.lit(0.0))
    return _sum(df, metric)


def all_metrics(df: DataFrame, fields: Fields) -> list[Column]:
    return [biz_metric(df, m, fields).alias(m) for m in METRICS if m in metric_options(fields)]


def _present_metrics(fields: Fields) -> list[str]:
    return [m for m in METRICS if m in metric_options(fields)]


# ---- periods -------------------------------------------------------------------------------------------

def dated(df: DataFrame, date: str, unit: str) -> DataFrame:
    """Rows with a date, plus _period (the period's first day)."""
    ts = parse_datetime(df, date)
    return df.filter(ts.isNotNull()).withColumn("_period", D.period_start(ts, unit))


def in_periods(df: DataFrame, date: str, unit: str, starts) -> DataFrame:
    """Rows of the named periods, plus _period. The ranges are literals on the date itself, so the scan can skip."""
    ts = parse_datetime(df, date)
    spans = [(ts >= F.lit(p).cast("timestamp_ntz")) & (ts < D.shift(F.lit(p), 1, unit).cast("timestamp_ntz")) for p in set(starts)]
    return df.filter(reduce(lambda a, b: a | b, spans)).withColumn("_period", D.period_start(ts, unit))


def period_trend(df: DataFrame, date: str, unit: str, fields: Fields) -> DataFrame:
    """period_start, period, metrics."""
    grouped = dated(df, date, unit)
    return grouped.groupBy(F.col("_period").alias("period_start")).agg(*all_metrics(grouped, fields)).withColumn(
        "period", D.period_label(F.col("period_start"), unit))


def period_dashboard(current: DataFrame, date: str, unit: str, fields: Fields,
                     history: DataFrame | None = None) -> DataFrame:
    """metric, current_period, value, previous, year_ago, mom, yoy.

    The current period is the last one in the slice; comparisons read the full history by calendar shift, and only
    the three periods concerned are aggregated.
    """
    history = current if history is None else history
    names = _present_metrics(fields)
    last = dated(current, date, unit).agg(F.max("_period")).first()[0]
    if last is None:
        none = "metric string, current_period string, value double, previous double, year_ago double, mom double, yoy double"
        return current.sparkSession.createDataFrame([], none)
    back = {"cur": 0, "prev": -1, "ago": -D.YEAR_BACK[unit]}
    starts = D.shifted_dates(history.sparkSession, last, back, unit)
    wanted = in_periods(history, date, unit, starts.values())
    per = wanted.groupBy("_period").agg(*all_metrics(wanted, fields))  # at most three rows
    wide = per.agg(F.lit(last).alias("period"), *[
        F.max(F.when(F.col("_period") == F.lit(p), F.col(m).cast("double"))).alias(f"{m}_{t}")
        for m in names for t, p in starts.items()])
    return C.to_rows(wide, [
        {"metric": F.lit(m), "current_period": D.period_label(F.col("period"), unit), "value": F.col(f"{m}_cur"),
         "previous": F.col(f"{m}_prev"), "year_ago": F.col(f"{m}_ago"),
         "mom": growth_percent(F.col(f"{m}_cur"), F.col(f"{m}_prev")),
         "yoy": growth_percent(F.col(f"{m}_cur"), F.col(f"{m}_ago"))} for m in names])


def growth_by_period(df: DataFrame, date: str, unit: str, value: str, signed: bool = False) -> DataFrame:
    """period, value, previous and growth per period, joined on the shifted calendar key (gaps stay NULL)."""
    rows = dated(df, date, unit)
    sums = rows.groupBy("_period").agg(_sum(rows, value).alias("value"))
    before = sums.select(D.shift(F.col("_period"), 1, unit).alias("_period"), F.col("value").alias("previous"))
    grow = growth_fraction if signed else growth_percent
    return sums.join(before, "_period", "left").select(
        D.period_label(F.col("_period"), unit).alias("period"), "value", "previous",
        grow(F.col("value"), F.col("previous")).alias("growth"))


# ---- dimensions ----------------------------------------------------------------------------------------

def _grouped(df: DataFrame, dimension: str, metric: str, fields: Fields) -> DataFrame:
    if dimension not in df.columns:
        raise KeyError(f"no such dimension: {dimension}")
    return df.groupBy(C.quoted(dimension)).agg(biz_metric(df, metric, fields).alias(metric))


def dimension_analysis(df: DataFrame, dimension: str, metric: str, fields: Fields) -> DataFrame:
    """dimension, metric value per dimension value (missing kept), largest first."""
    return _grouped(df, dimension, metric, fields).orderBy(F.desc_nulls_last(metric), C.quoted(dimension))


def dimension_topn(df: DataFrame, dimension: str, metric: str, fields: Fields, top_n: int | None = 10) -> DataFrame:
    """rank, dimension, metric. With N the rank window only sees the N rows that survive."""
    ordered = dimension_analysis(df, dimension, metric, fields)
    if top_n is None:
        grouped = _grouped(df, dimension, metric, fields)
        keys = [F.col(metric).isNull(), -F.col(metric), C.quoted(dimension)]
        ranked = with_global_order(grouped.withColumn("_one", F.lit(1)), keys, "_one", position="rank", running="_run")
        return ranked.select("rank", dimension, metric)
    window = Window.orderBy(F.desc_nulls_last(metric), F.col(dimension))
    return ordered.limit(top_n).select(F.row_number().over(window).cast("bigint").alias("rank"), dimension, metric)


def dimension_share(df: DataFrame, dimension: str, metric: str, fields: Fields) -> DataFrame:
    """dimension, metric, share_pct of the sum over all dimension values."""
    result = _grouped(df, dimension, metric, fields)
    total = result.agg(F.sum(metric)).scalar()  # reads the same shuffled groups, not the rows again
    return result.withColumn("_total", total).withColumn("share_pct", share_percent(F.col(metric), F.col("_total"))).drop(
        "_total").orderBy(F.desc_nulls_last(metric), C.quoted(dimension))


def _keep_top(df: DataFrame, dimension: str, metric: str, fields: Fields, top_n: int | None) -> DataFrame:
    """Rows of the N leading dimension values; the list has N rows, missing matches missing."""
    if top_n is None:
        return df
    top = dimension_analysis(df, dimension, metric, fields).limit(top_n).select(C.quoted(dimension).alias("_top"))
    top = F.broadcast(top) if top_n <= BROADCAST_TOP else top
    return df.join(top, C.quoted(dimension).eqNullSafe(F.col("_top")), "left_semi")  # N rows


def dimension_trend(df: DataFrame, date: str, dimension: str, metric: str, fields: Fields, unit: str = "month",
                    top_n: int | None = 5) -> DataFrame:
    """period, dimension, metric for the N leading values (all when None)."""
    rows = dated(_keep_top(df, dimension, metric, fields, top_n), date, unit)
    return rows.groupBy("_period", C.quoted(dimension)).agg(biz_metric(rows, metric, fields).alias(metric)).select(
        D.period_label(F.col("_period"), unit).alias("period"), dimension, metric)


@dataclass(frozen=True)
class Ranking:
    """A validated ranking question."""

    dimension: str
    metric: str
    limit: int | None = None
    recent_months: int | None = None
    growth: bool = False


def ranking_query(df: DataFrame, plan: Ranking, fields: Fields) -> DataFrame:
    if plan.dimension not in fields.dimensions:
        raise ValueError(f"not an analysis dimension: {plan.dimension}")
    if plan.metric not in metric_options(fields):
        raise ValueError(f"not a metric: {plan.metric}")
    if plan.recent_months and fields.date:
        df = filter_recent_months(df, fields.date, plan.recent_months)
    if plan.growth:
        return growth_ranking(df, plan.dimension, plan.metric, fields, plan.limit)
    return dimension_topn(df, plan.dimension, plan.metric, fields, plan.limit)


def growth_ranking(df: DataFrame, dimension: str, metric: str, fields: Fields, limit: int | None = None) -> DataFrame:
    """rank, dimension, first_value, last_value, growth_pct between the first and last month of the whole frame.

    The two months come back first (one row), so the aggregation reads only their rows.
    """
    if not fields.date:
        raise ValueError("growth needs a date column")
    rows = dated(df, fields.date, "month")
    first, last = rows.agg(F.min("_period"), F.max("_period")).first()
    if first is None or first == last:
        raise ValueError("growth needs at least two months")
    ends = in_periods(df, fields.date, "month", (first, last))
    per = ends.groupBy(C.quoted(dimension), "_period").agg(biz_metric(ends, metric, fields).cast("double").alias("v"))
    pair = per.groupBy(dimension).agg(
        F.max(F.when(F.col("_period") == F.lit(first), F.col("v"))).alias("first_value"),
        F.max(F.when(F.col("_period") == F.lit(last), F.col("v"))).alias("last_value"))
    grown = pair.withColumn("growth_pct", growth_percent(F.col("last_value"), F.col("first_value"))).filter(
        "growth_pct IS NOT NULL")
    if limit is not None:
        top = grown.orderBy(F.desc("growth_pct"), dimension).limit(limit)
        window = Window.orderBy(F.desc("growth_pct"), F.col(dimension))
        return top.select(F.row_number().over(window).cast("bigint").alias("rank"), *grown.columns)
    ranked = with_global_order(grown.withColumn("_one", F.lit(1)), [-F.col("growth_pct"), C.quoted(dimension)], "_one",
                               position="rank", running="_run")
    return ranked.select("rank", *grown.columns)


def top1_lead(ranked: DataFrame, dimension: str, value: str) -> DataFrame:
    """leader, value, runner_up, lead_pct of rank 1 over rank 2."""
    pair = ranked.filter(F.col("rank") <= 2).agg(
        F.max(F.when(F.col("rank") == 1, C.quoted(dimension))).alias("leader"),
        F.max(F.when(F.col("rank") == 1, F.col(value).cast("double"))).alias("value"),
        F.max(F.when(F.col("rank") == 2, F.col(value).cast("double"))).alias("runner_up"))
    return pair.withColumn("lead_pct", growth_percent(F.col("value"), F.col("runner_up")))


def top1_share_risk(result: DataFrame, dimension: str, value: str, growth_rate: float | None = None) -> DataFrame:
    """kind, message_key, subject, amount: findings, risks, comparisons and recommendations."""
    one = result.agg(
        F.min_by(C.quoted(dimension), F.struct(-F.col(value), C.quoted(dimension))).alias("top"),
        F.max(F.col(value)).cast("double").alias("top_value"), F.sum(value).cast("double").alias("total"),
    ).withColumn("share", F.try_divide(F.col("top_value"), F.nullif(F.col("total"), F.lit(0.0))))
    top, none = F.col("top").cast("string"), F.lit(None).cast("string")

    def row(kind: str, key: str, subject: Column, amount: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("message_key"), subject.alias("subject"),
                                     amount.cast("double").alias("amount")))

    heavy, rate = F.col("share") > 0.5, F.lit(growth_rate).cast("double")
    rows = F.array(
        row("finding", "top_contributor", top, F.col("top_value"), F.col("top_value").isNotNull()),
        row("risk", "high_concentration", top, F.col("share"), heavy),
        row("recommendation", "widen_sources", top, F.col("share"), heavy),
        row("comparison", "change_vs_previous", none, rate, rate.isNotNull()),
        row("finding", "clear_growth", none, rate, rate > 20),
        row("risk", "clear_decline", none, rate, rate < -20))
    return one.select(F.explode(rows).alias("r")).filter("r IS NOT NULL").select("r.*")


# ---- summaries -----------------------------------------------------------------------------------------

def _totals(df: DataFrame, fields: Fields) -> list[Column]:
    amount = _sum(df, fields.amount) if fields.amount else F.lit(None).cast("double")
    customers = _sum(df, fields.customer_count) if fields.customer_count else F.lit(None).cast("double")
    return [amount.alias("amount"), customers.alias("customers"),
            F.try_divide(_sum(df, fields.amount), F.nullif(customers, F.lit(0.0))).alias("unit_price"),
            _orders(fields).alias("orders")]


def summary_kpis(df: DataFrame, fields: Fields) -> DataFrame:
    """One row: totals, unit price = amount / customers, latest month's growth as signed fractions."""
    totals = df.agg(*_totals(df, fields))
    if not (fields.date and fields.amount):
        return totals.withColumns({"mom": F.lit(None).cast("double"), "yoy": F.lit(None).cast("double")})
    last = dated(df, fields.date, "month").agg(F.max("_period")).first()[0]
    starts = D.shifted_dates(df.sparkSession, last, {"cur": 0, "prev": -1, "ago": -12}, "month") if last else {}
    rows = in_periods(df, fields.date, "month", starts.values()) if last else dated(df, fields.date, "month")
    amount, month = C.as_double(rows, fields.amount), F.col("_period")
    sums = rows.agg(F.struct(*[
        F.coalesce(F.sum(F.when(month == F.lit(starts.get(k)), amount)), F.lit(0.0)).alias(k) for k in ("cur", "prev", "ago")])).scalar()
    return totals.withColumn("m", sums).select(
        "amount", "customers", "unit_price", "orders",
        growth_fraction(F.col("m.cur"), F.col("m.prev")).alias("mom"),
        growth_fraction(F.col("m.cur"), F.col("m.ago")).alias("yoy"))


def dimension_summary(df: DataFrame, dimension: str, fields: Fields, missing_label: str = "未填写") -> DataFrame:
    """dimension, amount, customers, unit_price, orders; missing values get a label; largest first."""
    label = F.coalesce(C.present(df, dimension).cast("string"), F.lit(missing_label)).alias(dimension)
    # a real value equal to the label stays its own group: the missing flag is part of the key
    grouped = df.groupBy(label, C.present(df, dimension).isNull().alias("_m")).agg(*_totals(df, fields))
    key = "amount" if fields.amount else "orders"
    return grouped.drop("_m").orderBy(F.desc_nulls_last(key), dimension)


def summary_time_trend(df: DataFrame, fields: Fields, unit: str | None = None) -> DataFrame:
    """period and totals per unit; without one, per day up to 62 days of span, else per month."""
    if unit is None:
        ts = parse_datetime(df, fields.date)
        low, high = df.agg(F.min(ts), F.max(ts)).first()
        unit = "month" if low is not None and (high - low).days > 62 else "day"
    rows = dated(df, fields.date, unit)
    return rows.groupBy("_period").agg(*_totals(rows, fields)).select(
        D.period_label(F.col("_period"), unit).alias("period"), "amount", "customers", "unit_price", "orders")


def periodic_sums(df: DataFrame, date: str, metrics: list[str], unit: str = "month", last: int = 12) -> DataFrame:
    """period and one sum per metric (NULL when a period has no value), the last N periods."""
    rows = dated(df, date, unit)
    sums = rows.groupBy("_period").agg(*[F.sum(C.as_double(rows, m)).alias(m) for m in metrics])
    return sums.orderBy(F.desc("_period")).limit(last).select(D.period_label(F.col("_period"), unit).alias("period"), *metrics)
