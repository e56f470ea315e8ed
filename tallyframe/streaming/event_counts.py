"""Event counts kept up to date from the append-only JSON log, over all time and by time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.sources.readers import EVENT_SCHEMA
from tallyframe.streaming.keyed_table import KEEP, KeyedTable

COUNTS = "event_name string, success boolean, count long"
WINDOWS = "window_start timestamp, window_end timestamp, event_name string, success boolean, count long"


def stream_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _name():
    return F.coalesce(F.nullif(F.col("event_name"), F.lit("")), F.lit("unknown")).alias("event_name")


def counts_stream(events: DataFrame) -> DataFrame:
    """event_name, success, count; the state holds one row per (name, success)."""
    return events.groupBy(_name(), "success").agg(F.count(F.lit(1)).alias("count"))


def window_counts_stream(events: DataFrame, every: str, delay: str, ts: str = "timestamp") -> DataFrame:
    """WINDOWS of an event stream. The state holds the windows that end after the watermark."""
    timed = events.withColumn("_at", F.try_to_timestamp(F.col(ts))).withWatermark("_at", delay)
    counts = timed.groupBy(F.window("_at", every), _name(), "success").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_name", "success", "count")


def run_merge(changes: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Process everything new, then stop. Each batch hands on only the rows that it changed (update mode)."""
    query = (changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(table.merge).start())
    query.awaitTermination()


def run_counts(spark: SparkSession, log: str, out: str, checkpoint: str, files_per_batch: int | None = None, keep: int = KEEP) -> DataFrame:
    """Brings the counts in ``out`` up to date with the log; returns them."""
    table = KeyedTable(spark, out, COUNTS, ["event_name", "success"], keep)
    run_merge(counts_stream(stream_events(spark, log, files_per_batch)), table, checkpoint)
    return table.read()


def run_window_counts(spark: SparkSession, log: str, out: str, checkpoint: str, every: str = "1 hour", delay: str = "1 day",
                      files_per_batch: int | None = None, keep: int = KEEP) -> DataFrame:
    """Brings the counts per time window in ``out`` up to date with the log; returns WINDOWS.

    The late rule: with one batch a run, a row is left out if its window ended at or before the latest event time (in whole
    milliseconds) of all earlier runs less ``delay``; so a window is final, and leaves the state, once that time has passed it. Rows
    without a readable time are in no window.
    """
    table = KeyedTable(spark, out, WINDOWS, ["window_start", "window_end", "event_name", "success"], keep)
    run_merge(window_counts_stream(stream_events(spark, log, files_per_batch), every, delay), table, checkpoint)
    return table.read()
