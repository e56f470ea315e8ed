"""Event-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import columns as C

# The product's main flow, in order.
MAIN_FLOW = ("dataset_uploaded", "dataset_selected", "data_quality_viewed", "cleaned_dataset_generated",
             "report_export_clicked", "report_export_success", "report_export_failed")
RECENT_COLUMNS = ("timestamp", "event_name", "success", "dataset_type", "project_id", "duration_ms", "error_type")


def event_summary(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """total, success_count, failure_count, success_rate (percent, 2 decimals), latest_timestamp."""
    total = F.count(F.lit(1))
    good = F.count_if(F.col("success"))
    return df.agg(total.alias("total"), good.alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"),
                  F.bround(F.coalesce(good / F.nullif(total, F.lit(0)) * 100, F.lit(0.0)), 2).alias("success_rate"),
                  F.max(ts).alias("latest_timestamp"))


def _name():
    return F.coalesce(F.nullif(F.col("event_name"), F.lit("")), F.lit("unknown")).alias("event_name")


def event_counts(df: DataFrame) -> DataFrame:
    """event_name, count; most frequent first, then by name."""
    return df.groupBy(_name()).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "event_name")


def event_funnel(df: DataFrame, stages=MAIN_FLOW) -> DataFrame:
    """position, event_name, count for a fixed list of names, 0 when absent."""
    fixed = df.sparkSession.createDataFrame(list(enumerate(stages, 1)), "position int, event_name string")
    counts = df.filter(F.col("event_name").isin(*stages)).groupBy("event_name").agg(F.count(F.lit(1)).alias("count"))
    return fixed.join(F.broadcast(counts), "event_name", "left").select(  # at most one row per stage
        "position", "event_name", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def event_recent(df: DataFrame, n: int = 20, order: list[str] = ("timestamp",), columns=RECENT_COLUMNS) -> DataFrame:
    """Latest n events, compact columns."""
    kept = [C.quoted(c) for c in columns if c in df.columns]
    return df.orderBy(*[F.desc(c) for c in order]).limit(max(int(n), 0)).select(*kept)


def event_dedup_once(df: DataFrame, session: str, key: str, fingerprint: str, ts: str, tie: str, unit: str = "hour") -> DataFrame:
    """Events whose fingerprint differs from the one before under the same session and state key.

    The order inside a session is cut into time slots, so a session with a third of all events is spread over
    many tasks; the last fingerprint of each slot is carried over to the next slot that has events.
    """
    slot = F.date_trunc(unit, C.quoted(ts))
    keys = [C.quoted(session), C.quoted(key)]
    cut = df.withColumns({"_s": keys[0], "_k": keys[1], "_slot": slot, "_f": C.quoted(fingerprint)})
    order = [C.quoted(ts), C.quoted(tie)]
    ends = cut.groupBy("_s", "_k", "_slot").agg(F.max_by("_f", F.struct(*order)).alias("_end"))
    carried = ends.select(
        F.col("_s").alias("_cs"), F.col("_k").alias("_ck"), F.col("_slot").alias("_cslot"),
        F.lag("_end").over(Window.partitionBy("_s", "_k").orderBy("_slot")).alias("_carried"))
    inside = Window.partitionBy("_s", "_k", "_slot").orderBy(*order)
    placed = cut.withColumns({"_prev": F.lag("_f").over(inside), "_n": F.row_number().over(inside)})
    joined = placed.join(carried, F.col("_s").eqNullSafe(F.col("_cs")) & F.col("_k").eqNullSafe(F.col("_ck"))
                         & F.col("_slot").eqNullSafe(F.col("_cslot")), "left")
    before = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    return joined.filter(~F.col("_f").eqNullSafe(before)).select(*[C.quoted(c) for c in df.columns])
