"""Table and column profiles: every statistic of every column from one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions import columns as C
from tallyframe.functions.parsing import parse_datetime, parse_datetime_text
from tallyframe.functions.stats import sample_kurtosis, sample_skewness
from tallyframe.operators.quantiles import exact_quantiles, literal

ROW_ID = "_row_id"
WIDE = 64


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def comparable(df: DataFrame, name: str) -> Column:
    """Value used for distinct counts; maps and other unordered values are compared as JSON text."""
    dtype = C.dtype_of(df, name)
    return F.to_json(C.quoted(name)) if isinstance(dtype, T.MapType) else C.present(df, name)


def column_profile(df: DataFrame, columns: list[str] | None = None, distinct: str = "exact",
                   dates: list[str] = ()) -> DataFrame:
    """One row per column: position, column, dtype, family, total, non_null, distinct_count, whole, parsed.

    ``whole``: every number is an integer. ``parsed``: values that read as dates, for the text columns in ``dates``.
    ``distinct``: exact (by value groups), approx (HyperLogLog, one pass without a shuffle of values) or none.
    """
    columns = columns or data_columns(df)
    stats = _by_groups(df, columns, dates) if distinct == "exact" else _one_pass(df, columns, distinct, dates)
    schema = "position int, column string, dtype string, family string"
    fixed = df.sparkSession.createDataFrame(
        [(i, c, C.dtype_of(df, c).simpleString(), C.family_of(C.dtype_of(df, c))) for i, c in enumerate(columns)], schema)
    zero = F.lit(0).cast("bigint")
    counted = None if distinct == "none" else F.coalesce(F.col("distinct_count"), zero)
    text = F.col("column").isin(list(dates)) if dates else F.lit(False)
    return fixed.join(F.broadcast(stats), "position", "left").select(  # one row per column
        "position", "column", "dtype", "family", F.coalesce("total", zero).alias("total"),
        F.coalesce("non_null", zero).alias("non_null"),
        (F.lit(None).cast("bigint") if counted is None else counted).alias("distinct_count"), "whole",
        F.when(text, F.coalesce("parsed", zero)).alias("parsed"))


def _one_pass(df: DataFrame, columns: list[str], distinct: str, dates) -> DataFrame:
    aggs, rows = [F.count(F.lit(1)).alias("total")], []
    none = {"bigint": F.lit(None).cast("bigint"), "boolean": F.lit(None).cast("boolean")}
    for i, c in enumerate(columns):
        value, row = C.present(df, c), dict(distinct_count=none["bigint"], whole=none["boolean"], parsed=none["bigint"])
        aggs.append(F.count(value).alias(f"n{i}"))
        if distinct == "approx":
            aggs.append(F.approx_count_distinct(comparable(df, c)).alias(f"d{i}"))
            row["distinct_count"] = F.col(f"d{i}")
        if C.is_numeric(C.dtype_of(df, c)):
            aggs.append(F.bool_and(F.pmod(value.cast("double"), F.lit(1.0)) == 0).alias(f"w{i}"))
            row["whole"] = F.col(f"w{i}")
        if c in dates and C.is_text(C.dtype_of(df, c)):
            aggs.append(F.count(parse_datetime(df, c)).alias(f"p{i}"))
            row["parsed"] = F.col(f"p{i}")
        rows.append({"position": F.lit(i), "total": F.col("total"), "non_null": F.col(f"n{i}"), **row})
    return C.to_rows(df.agg(*aggs), rows)


def _by_groups(df: DataFrame, columns: list[str], dates) -> DataFrame:
    """Exact distinct counts from (column, value) groups, one narrow pass per value type.

    Many ``count(DISTINCT)`` in one aggregate repeat every row per column with all the columns in the key; these
    groups carry one value each, collapse copies before the shuffle, and let dates be parsed once per distinct text.
    Texts of more than WIDE bytes go as a 128-bit digest (parsed before it is taken), so a row in the shuffle is short whatever
    the column holds; among n different texts two share one with a probability below n * n / 2^129.
    """
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kinds.setdefault(_value_kind(C.dtype_of(df, c)), []).append(i)
    parts = []
    for kind, members in kinds.items():
        pairs = F.array(*[F.struct(F.lit(i).alias("position"), comparable(df, columns[i]).cast(kind).alias("v")) for i in members])
        values, key = df.select(F.inline(pairs)), ["position", "v"]
        wanted = [i for i in members if columns[i] in dates and C.is_text(C.dtype_of(df, columns[i]))]
        reads_wide = F.lit(False)
        if kind == "string":
            wide = F.octet_length("v") > WIDE
            if wanted:
                reads_wide = F.when(wide & F.col("position").isin(wanted), parse_datetime_text(F.col("v")).isNotNull())
            values = values.select("position", F.when(wide, F.md5("v")).otherwise(F.col("v")).alias("v"), F.coalesce(wide, F.lit(False)).alias("wide"),
                                   F.coalesce(reads_wide, F.lit(False)).alias("read"))
            key = ["position", "v", "wide", "read"]
        groups = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        v, n = F.col("v"), F.col("n")
        whole, parsed = F.lit(None).cast("boolean"), F.lit(None).cast("bigint")
        if kind in ("bigint", "double") or kind.startswith("decimal"):
            whole = F.bool_and(F.pmod(v.cast("double"), F.lit(1.0)) == 0)
        if wanted:
            reads = F.when(F.col("position").isin(wanted) & ~F.col("wide"), parse_datetime_text(v))
            parsed = F.sum(F.when(reads.isNotNull() | F.col("read"), n))
        parts.append(groups.groupBy("position").agg(
            F.sum("n").alias("total"), F.sum(F.when(v.isNotNull(), n)).alias("non_null"), F.count("v").alias("distinct_count"),
            whole.alias("whole"), parsed.alias("parsed")))
    return reduce(DataFrame.unionByName, parts)


def _value_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if C.is_float(dtype):
        return "double"
    return "string" if C.is_text(dtype) or isinstance(dtype, T.MapType) else dtype.simpleString()


def missing_count() -> Column:
    return F.col("total") - F.col("non_null")


def missing_percent() -> Column:
    return C.percent(missing_count(), F.col("total"))


def unique_ratio() -> Column:
    """distinct / non-null, 0 for an empty column."""
    return F.coalesce(F.try_divide(F.col("distinct_count"), F.col("non_null")), F.lit(0.0))


def pinned(rows: DataFrame) -> DataFrame:
    """A result with one row per column, fetched once so that later steps do not scan the data again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def field_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """column, dtype, missing_count, missing_pct, distinct_count."""
    return column_profile(df, distinct=distinct).select(
        "column", "dtype", missing_count().alias("missing_count"),
        missing_percent().alias("missing_pct"), "distinct_count")


def basic_info(df: DataFrame) -> DataFrame:
    """row_count, column_count, duplicate_rows; copies are counted before the shuffle."""
    columns = data_columns(df)
    copies = df.groupBy(*[comparable(df, c).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, unique, top, freq: distinct values and the most frequent one as text, smallest on ties.

    Counting goes through (column, value) groups, so no task ever holds a column's whole value map.
    """
    counted = value_counts(df, columns).filter("value IS NOT NULL")
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("value").alias("v")))
    return counted.groupBy("column").agg(best.alias("_b"), F.count(F.lit(1)).alias("unique")).select(
        "column", "unique", F.col("_b.v").alias("top"), (-F.col("_b.n")).alias("freq"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text), count over several columns from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), C.present(df, c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: count, unique/top/freq (non-numeric), mean/std/min/quartiles/max (numeric)."""
    columns = data_columns(df)
    numeric = [c for c in columns if C.is_numeric(C.dtype_of(df, c))]
    other = [c for c in columns if c not in numeric]
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    aggs = [F.count(C.present(df, c)).alias(f"n_{c}") for c in columns]
    for c in numeric:
        v = C.as_double(df, c)
        aggs += [F.avg(v).alias(f"mean_{c}"), F.stddev_samp(v).alias(f"std_{c}"),
                 F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    null_d, null_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    rows = []
    for c in columns:
        q = quartiles.get(c, [None] * 3)
        is_num = c in quartiles
        rows.append({
            "column": F.lit(c), "count": C.quoted(f"n_{c}"),
            "mean": C.quoted(f"mean_{c}") if is_num else null_d,
            "std": C.quoted(f"std_{c}") if is_num else null_d,
            "min": C.quoted(f"min_{c}") if is_num else null_d,
            "p25": literal(q[0]), "p50": literal(q[1]), "p75": literal(q[2]),
            "max": C.quoted(f"max_{c}") if is_num else null_d,
        })
    stats = C.to_rows(df.agg(*aggs), rows)
    if not other:
        return stats.withColumns({"unique": null_l, "top": F.lit(None).cast("string"), "freq": null_l})
    return stats.join(F.broadcast(top_values(df, other)), "column", "left")  # one row per column


def date_range(df: DataFrame) -> DataFrame:
    """First date/time column that has values: column, min_date, max_date (no row when there is none)."""
    dates = [c for c in data_columns(df) if C.is_datetime(C.dtype_of(df, c))]
    if not dates:
        return df.sparkSession.createDataFrame([], "column string, min_date date, max_date date")
    one = df.agg(*[f(C.quoted(c)).cast("date").alias(f"{k}{i}")
                   for i, c in enumerate(dates) for k, f in (("a", F.min), ("b", F.max))])
    found = [F.when(F.col(f"a{i}").isNotNull(),
                    F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("min_date"),
                             F.col(f"b{i}").alias("max_date")))
             for i, c in enumerate(dates)]
    return one.select(F.coalesce(*found).alias("r")).filter("r IS NOT NULL").select("r.*")


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std, min, max, skew, kurtosis for all columns from one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        v = C.as_double(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                 F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
                 sample_skewness(v).alias(f"skew{i}"), sample_kurtosis(v).alias(f"kurtosis{i}")]
    keys = ("n", "mean", "std", "min", "max", "skew", "kurtosis")
    return C.to_rows(df.agg(*aggs), [
        {"column": F.lit(c), **{k: F.col(f"{k}{i}") for k in keys}} for i, c in enumerate(columns)])


def exportable_cells(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, zoned timestamps as wall time, other opaque values as text."""
    out = {}
    for f in df.schema.fields:
        if C.is_nested(f.dataType):
            out[f.name] = F.to_json(C.quoted(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out[f.name] = C.quoted(f.name).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.BinaryType):
            out[f.name] = F.base64(C.quoted(f.name))
    return df.withColumns(out) if out else df


def head_rows(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*[C.quoted(c).desc() for c in order]).limit(n)


def sample_rows(df: DataFrame, n: int = 20, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Exactly n rows, the same ones every time: those with the smallest seeded hash of the key columns (else of the row)."""
    if key:
        drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), *[C.quoted(c).cast("string") for c in key]))
    else:
        drawn = F.xxhash64(F.lit(seed), *[F.to_json(C.quoted(c)) if isinstance(C.dtype_of(df, c), T.MapType) else C.quoted(c) for c in df.columns])
    hashed = df.withColumn("_h", drawn)
    return hashed.orderBy("_h", *[C.quoted(c) for c in df.columns if not isinstance(C.dtype_of(df, c), T.MapType)]).limit(n).drop("_h")
