"""Global order over a frame that may be large: rank and running sum without one big sorted task.

The frame is dealt into ranges of the order, one for every ``range_rows`` rows. Ranks and running sums are computed inside
each range, and the ranges' totals give the offsets. No key reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.session import cut_lineage

RANGE_ROWS = 1_000_000


def with_global_order(df: DataFrame, order: list[Column], weight: str, range_rows: int | None = None,
                      position: str = "position", running: str = "running", at_most: int | None = None) -> DataFrame:
    """Add ``position`` (1..n) and ``running`` (sum of ``weight`` up to and including the row).

    ``order`` are ascending key expressions that together are unique (negate a number to go descending).
    ``at_most``: a known bound on the rows; within one range it saves the counting job.
    """
    range_rows = RANGE_ROWS if range_rows is None else range_rows
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)]))
    total = at_most if at_most is not None and at_most <= range_rows else keyed.count()
    ranges = -(-total // range_rows)
    if ranges <= 1:
        window = Window.orderBy("_key")
        return keyed.withColumns({
            position: F.row_number().over(window).cast("bigint"),
            running: F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, 0)),
        }).drop("_key")
    # checkpointed, so that rows stay in their range however often the plan below runs
    cut = cut_lineage(keyed.repartitionByRange(ranges, "_key").withColumn("_range", F.spark_partition_id()))
    totals = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum(weight).alias("_weight"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row a range
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight_before"),
    )
    window = Window.partitionBy("_range").orderBy("_key")
    return (
        cut.withColumns({
            position: F.row_number().over(window).cast("bigint"),
            running: F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, 0)),
        })
        .join(offsets, "_range")
        .withColumns({
            position: F.col(position) + F.col("_rows_before"),
            running: F.col(running) + F.col("_weight_before"),
        })
        .drop("_key", "_range", "_rows_before", "_weight_before")
    )
