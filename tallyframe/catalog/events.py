"""Event log, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry
from tallyframe.operators import event_properties as V, events as E
from tallyframe.session import scratch_path
from tallyframe.streaming.event_counts import run_counts, run_window_counts, stream_events
from tallyframe.streaming.state_changes import run_dedup_once

R = Registry()
STAGES = ("view", "click", "purchase", "signup", "error", "report_export_success", "report_export_failed")


@R.add("event_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE NOT success) AS failure_count,
 round_even(count(*) FILTER (WHERE success) / count(*) * 100, 2) AS success_rate, max(ts) AS latest_timestamp FROM event_log""")
def _(d):
    return E.event_summary(d.event_log, "ts")


@R.add("event_counts", """SELECT coalesce(CASE WHEN event_id % 50 <> 0 THEN event_name END, 'unknown') AS event_name, count(*) AS "count" FROM event_log GROUP BY 1""")
def _(d):
    return E.event_counts(d.event_log.withColumn("event_name", F.when(F.col("event_id") % 50 != 0, F.col("event_name"))))


@R.add("event_funnel", "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES, 1))
       + """) AS t(position, event_name)) SELECT s.position, s.event_name, count(e.event_id) AS "count" FROM s LEFT JOIN event_log e ON e.event_name = s.event_name GROUP BY 1, 2""")
def _(d):
    return E.event_funnel(d.event_log, STAGES)


@R.add("event_recent", "SELECT ts, event_name, success, duration_ms FROM event_log ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(d):
    return E.event_recent(d.event_log, 20, ["ts", "event_id"], ("ts", "event_name", "success", "duration_ms"))


@R.add("event_dedup_once", """SELECT event_id, session_id, event_name, ts FROM (SELECT *, lag(success) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM event_log)
 WHERE prev IS DISTINCT FROM success""")
def _(d):
    log = d.event_log.withColumn("state_key", F.lit("flow"))
    return E.event_dedup_once(log, "session_id", "state_key", "success", "ts", "event_id").select("event_id", "session_id", "event_name", "ts")


TREE = "SELECT event_id, CASE WHEN json_valid(properties) THEN CAST(properties AS JSON) END AS j FROM event_tree"


@R.add("event_property_paths", f"""SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path,
 CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
 ELSE 'number' END AS kind, count(*) AS "values" FROM ({TREE}) e, json_tree(e.j) t WHERE e.j IS NOT NULL GROUP BY 1, 2""")
def _(d):
    return V.property_paths(d.event_tree)


@R.add("event_property_columns", f"""SELECT event_id, j->>'$.device.os' AS os, CAST(j->>'$.device.mem' AS DOUBLE) AS mem,
 CAST(j->>'$.tags[0]' AS BIGINT) AS first_tag, TRY_CAST(j->>'$.tags[1]' AS BIGINT) AS second_tag FROM ({TREE})""")
def _(d):
    wanted = {"os": ("$.device.os", "string"), "mem": ("$.device.mem", "double"), "first_tag": ("$.tags[0]", "bigint"), "second_tag": ("$.tags[1]", "bigint")}
    return V.property_columns(d.event_tree, wanted).select("event_id", *wanted)


@R.add("event_property_groups", f"""SELECT j->>'$.device.os' AS "value", count(*) AS events, count(j->>'$.k') AS measured,
 sum(CAST(j->>'$.k' AS DOUBLE)) AS total, max(CAST(j->>'$.k' AS DOUBLE)) AS largest FROM ({TREE}) GROUP BY 1""")
def _(d):
    return V.property_groups(d.event_tree, "$.device.os", "$.k")


ARRIVALS = 4
# Rows arrive in order of their id, but every tenth one round later and every 25th two rounds later.
IN_ORDER = f"CAST(floor(event_id * {ARRIVALS} / (last_id + 1)) AS INT)"
ARRIVAL = f"least({ARRIVALS - 1}, {IN_ORDER} + CASE WHEN event_id % 25 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"


def _arrived(d, arrival: str) -> list:
    """The log in rounds of arrival, as JSON Lines would hold it."""
    last = d.event_log.agg(F.max("event_id").alias("last_id")).first()["last_id"]
    log = d.event_log.selectExpr("CAST(event_id AS STRING) AS event_id", "event_name", "CAST(ts AS STRING) AS timestamp",
                                 "CAST(session_id AS STRING) AS session_id", "success", "duration_ms", f"{arrival.replace('last_id', str(last))} AS arrival")
    return [log.filter(F.col("arrival") == i).drop("arrival") for i in range(ARRIVALS)]


@R.add("event_stream_counts", """SELECT event_name, success, count(*) AS "count" FROM event_log GROUP BY 1, 2""")
def _(d):
    log, out, ckpt = (scratch_path(d.spark, n) for n in ("stream_log", "stream_counts", "stream_checkpoint"))
    d.event_log.select(F.col("event_id").cast("string").alias("event_id"), "event_name", F.col("ts").cast("string").alias("timestamp"),
                       "success", "duration_ms").write.mode("append").json(log)
    return run_counts(d.spark, log, out, ckpt, files_per_batch=64)


@R.add("event_stream_windows", f"""WITH a AS (SELECT *, {ARRIVAL} AS arrival FROM event_log, (SELECT max(event_id) AS last_id FROM event_log)),
 m AS (SELECT arrival, date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM a GROUP BY 1),
 w AS (SELECT a.*, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, (SELECT max(mark) FROM m WHERE m.arrival < a.arrival) AS mark FROM a)
 SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_name, success, count(*) AS "count" FROM w
 WHERE mark IS NULL OR window_start + INTERVAL 6 HOUR > mark GROUP BY 1, 2, 3, 4""")
def _(d):
    log, out, ckpt = (scratch_path(d.spark, n) for n in ("stream_log", "stream_windows", "stream_checkpoint"))
    for part in _arrived(d, ARRIVAL):
        part.write.mode("append").json(log)
        counts = run_window_counts(d.spark, log, out, ckpt, "6 hours", "1 day")
    return counts


@R.add("event_stream_dedup", """SELECT event_id, session_id, event_name, ts FROM (SELECT *, lag(success) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM event_log)
 WHERE prev IS DISTINCT FROM success""")
def _(d):
    log, out, state, ckpt = (scratch_path(d.spark, n) for n in ("stream_log", "stream_changes", "stream_state", "stream_checkpoint"))
    for part in _arrived(d, IN_ORDER):
        part.write.mode("append").json(log)
        events = stream_events(d.spark, log).select(
            F.col("event_id").cast("long"), F.col("session_id").cast("long"), "event_name", F.to_timestamp("timestamp").alias("ts"), "success",
            F.lit("flow").alias("state_key"))
        changes = run_dedup_once(events, out, state, ckpt, "session_id", "state_key", "success", "ts", "event_id")
    return changes.select("event_id", "session_id", "event_name", "ts")
