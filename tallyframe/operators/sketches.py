"""Profiles from mergeable sketches: one small row per partition and column, united into the profile of any set of partitions.

Counts, minimum and maximum are exact. Distinct counts are HyperLogLog estimates, quantiles come from KLL sketches;
both errors are stated in the result. A new day costs a scan of that day, whatever has been stored before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import profiling as P

LG_REGISTERS = 12  # 4096 registers: a relative standard error of 1.04 / 64
KLL_K = 200
# Of a KLL sketch with k = 200: a quantile's rank is off by less than this share of the values, at 99 % confidence.
RANK_ERROR = 0.0133
SKETCH = ("column string, position int, dtype string, rows long, non_null long, low double, high double, distinct_sketch binary, "
          "quantile_sketch binary")


def distinct_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative standard error of a united distinct count."""
    return 1.04 / 2 ** (lg_registers / 2)


def partition_sketches(df: DataFrame, by: list[str], columns: list[str] | None = None, lg_registers: int = LG_REGISTERS, k: int = KLL_K) -> DataFrame:
    """by, SKETCH: one row per partition and column, from one aggregate. Sketches are combined in the tasks, so a large
    partition is one row a task in the shuffle.

    Values are compared by a 64-bit hash. Numeric columns have minimum, maximum and a quantile sketch of their values without
    NaN; the others have none.
    """
    columns = [c for c in (columns or P.data_columns(df)) if c not in by]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(columns):
        value = P.comparable(df, c)
        aggs += [F.count(value).alias(f"_n{i}"), F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(lg_registers)).alias(f"_d{i}")]
        number = C.as_double(df, c) if C.is_numeric(C.dtype_of(df, c)) else None
        if number is not None:
            aggs += [F.min(number).alias(f"_l{i}"), F.max(number).alias(f"_h{i}"), F.kll_sketch_agg_double(number, F.lit(k)).alias(f"_q{i}")]
        none = F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(C.dtype_of(df, c).simpleString()).alias("dtype"), F.col("_rows").alias("rows"),
            F.col(f"_n{i}").alias("non_null"), (none if number is None else F.col(f"_l{i}")).alias("low"),
            (none if number is None else F.col(f"_h{i}")).alias("high"), F.col(f"_d{i}").alias("distinct_sketch"),
            (F.lit(None).cast("binary") if number is None else F.when(F.col(f"_n{i}") > 0, F.col(f"_q{i}"))).alias("quantile_sketch")))
    return df.groupBy(*[C.quoted(b) for b in by]).agg(*aggs).select(*[C.quoted(b) for b in by], F.inline(F.array(*rows)))


def store_sketches(sketches: DataFrame, path: str, by: list[str]) -> None:
    """Adds partitions to a stored table of sketches; a partition that is there already is replaced, so a repeated day counts once."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def united(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, SKETCH: the sketches of many partitions (or of the groups of ``by``) as one row per column."""
    return sketches.groupBy(*[C.quoted(b) for b in by], "column").agg(
        F.max("position").alias("position"), F.max("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def quantile(share: float) -> Column:
    """A quantile of the column, NULL without values."""
    return F.when((F.col("non_null") > 0) & F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(share))))


def sketched_profile(sketches: DataFrame, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """column, dtype, missing_count, missing_pct, distinct_count, distinct_error, low, high.

    distinct_count is within three times distinct_error (a relative standard error) for 99.7 % of columns.
    """
    missing = F.col("rows") - F.col("non_null")
    return united(sketches).select(
        "column", "dtype", missing.alias("missing_count"), C.percent(missing, F.col("rows")).alias("missing_pct"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), F.lit(distinct_error(lg_registers)).alias("distinct_error"), "low", "high")


def sketched_iqr_bounds(sketches: DataFrame, factor: float = 1.5) -> DataFrame:
    """column, q1, q3, iqr, lower_bound, upper_bound, rank_error of the numeric columns.

    The rank of q1 and q3 among the values is within rank_error of 0.25 and 0.75, at 99 % confidence.
    """
    q1, q3 = F.col("q1"), F.col("q3")
    return united(sketches).filter("low IS NOT NULL").select("column", quantile(0.25).alias("q1"), quantile(0.75).alias("q3")).select(
        "column", "q1", "q3", (q3 - q1).alias("iqr"), (q1 - factor * (q3 - q1)).alias("lower_bound"), (q3 + factor * (q3 - q1)).alias("upper_bound"),
        F.lit(RANK_ERROR).alias("rank_error"))
