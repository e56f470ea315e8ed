"""Category composition. The value counts are the working set; raw rows are aggregated before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import profiling as P
from tallyframe.operators.ranking import with_global_order

LOW_SHARE = 0.01


def counts_of(df: DataFrame, column: str) -> DataFrame:
    """category (text), count; missing left out."""
    return df.select(C.present(df, column).cast("string").alias("category")).filter("category IS NOT NULL").groupBy(
        "category").agg(F.count(F.lit(1)).alias("count"))


def _order() -> list[Column]:
    """Most frequent first, then text without case, then text."""
    return [-F.col("count"), F.lower("category"), F.col("category")]


def category_composition(df: DataFrame, column: str, range_rows: int | None = None) -> DataFrame:
    """rank, category, count, ratio, cumulative_ratio for every category."""
    valid = df.agg(F.count(C.present(df, column))).scalar()
    ranked = with_global_order(counts_of(df, column), _order(), "count", range_rows, position="rank", running="upto")
    return ranked.select("rank", "category", "count", (F.col("count") / valid).alias("ratio"),
                         (F.col("upto") / valid).alias("cumulative_ratio"))


def composition_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: status, counts, top category, top1/top5 ratio, low-frequency (< 1 %) count and ratio."""
    counts = counts_of(df, column)
    rows = df.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count(C.present(df, column)).alias("valid"))).scalar()
    top5 = counts.orderBy(*_order()).limit(5).agg(
        F.struct(F.sum("count").alias("n"), F.max("count").alias("first"),
                 F.min_by("category", F.struct(*_order())).alias("name"))).scalar()
    # the threshold is a literal of one row, so the low-frequency test is a plain condition
    share = F.col("count") / F.nullif(rows["valid"], F.lit(0))
    body = counts.agg(F.count(F.lit(1)).alias("category_count"), F.count_if(share < LOW_SHARE).alias("low_frequency_count"),
                      F.coalesce(F.sum(F.when(share < LOW_SHARE, F.col("count"))), F.lit(0)).alias("low"))
    valid = F.nullif(F.col("r.valid"), F.lit(0))
    status = F.when(F.col("category_count") == 0, "no_valid_data").when(F.col("category_count") == 1, "constant").otherwise("ok")
    zero = F.lit(0.0)
    return body.withColumns({"r": rows, "t": top5}).select(
        status.alias("status"), F.col("r.total").alias("total_count"), F.col("r.valid").alias("valid_count"),
        (F.col("r.total") - F.col("r.valid")).alias("excluded_count"), "category_count", F.col("t.name").alias("top1_category"),
        F.coalesce(F.col("t.first"), F.lit(0)).alias("top1_count"), F.coalesce(F.col("t.first") / valid, zero).alias("top1_ratio"),
        F.coalesce(F.col("t.n") / valid, zero).alias("top5_ratio"), "low_frequency_count",
        F.coalesce(F.col("low") / valid, zero).alias("low_frequency_ratio"))


def category_topn_other(df: DataFrame, column: str, top_n: int, other_label: str = "其他（合并）") -> DataFrame:
    """Top N plus one merged row, flagged apart from a real category of that name."""
    counts = counts_of(df, column)
    valid = df.agg(F.count(C.present(df, column))).scalar()
    top = counts.orderBy(*_order()).limit(max(1, int(top_n)))
    head = top.select("category", "count", (F.col("count") / valid).alias("ratio"), F.lit(False).alias("is_merged_other"))
    rest = top.agg(F.sum("count").alias("n")).select(
        F.lit(other_label).alias("category"), (valid - F.col("n")).alias("count")).filter(F.col("count") > 0)
    return head.unionByName(rest.select("category", "count", (F.col("count") / valid).alias("ratio"),
                                        F.lit(True).alias("is_merged_other")))


def category_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, top_value, top_count, top_pct, distinct_count for all columns from one scan."""
    counts = P.value_counts(df, columns).filter("value IS NOT NULL")
    found = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("n"), F.col("value").alias("v"))).alias("b"),
        F.sum("count").alias("valid"), F.count(F.lit(1)).alias("distinct_count"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    zero = F.lit(0).cast("bigint")
    return names.join(F.broadcast(found), "column", "left").select(  # one row per column
        "column", F.col("b.v").alias("top_value"), F.coalesce(-F.col("b.n"), zero).alias("top_count"),
        C.percent(F.coalesce(-F.col("b.n"), zero), F.coalesce("valid", zero)).alias("top_pct"),
        F.coalesce("distinct_count", zero).alias("distinct_count"))


def top_per_column(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each column; the row-number limit is applied before the shuffle too."""
    window = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def concentration(top_pct: Column) -> Column:
    return F.when(top_pct >= 80, "high").when(top_pct >= 50, "medium").otherwise("scattered")


def category_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct_count, top_value, top1_pct, top5_pct, concentration."""
    counts = P.value_counts(df, columns).filter("value IS NOT NULL")
    sizes = counts.groupBy("column").agg(F.sum("count").alias("valid"), F.count(F.lit(1)).alias("distinct_count"))
    tops = top_per_column(counts, 5).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top_value"),
        F.max("count").alias("first"), F.sum("count").alias("five"))
    share = C.percent(F.col("first"), F.col("valid"))
    return sizes.join(F.broadcast(tops), "column").select(  # one row per column
        "column", "distinct_count", "top_value", share.alias("top1_pct"),
        C.percent(F.col("five"), F.col("valid")).alias("top5_pct"), concentration(share).alias("concentration"))
