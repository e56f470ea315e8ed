"""Events that change the state of their session, kept up to date from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.operators.events import event_dedup_once
from tallyframe.streaming.keyed_table import KEEP, KeyedTable


def run_dedup_once(events: DataFrame, out: str, state: str, checkpoint: str, session: str, key: str, fingerprint: str, ts: str, tie: str,
                   unit: str = "hour", keep: int = KEEP) -> DataFrame:
    """Process everything new in a stream of events, then stop; returns the events so far whose fingerprint differs from the one
    before under the same session and key, as event_dedup_once does on a table.

    The state is one row per session and key: the fingerprint, time and tie breaker of its last event. A batch puts it before its
    own events and runs the batch operator over both, so however the log is cut into batches, the result is that of the
    whole log, and a session with a third of a batch is spread over time slots. The late rule: an event that is not after the last
    one of its session and key in an earlier batch is left out; without a time it comes first, so only a key's first batch can hold it.

    Results of a batch and its changes of the state are replaced if it is repeated; it reads the state as it was before.
    """
    spark = events.sparkSession
    kinds = {n: C.dtype_of(events, n).simpleString() for n in (session, key, fingerprint, ts, tie)}
    table = KeyedTable(spark, state, f"_s {kinds[session]}, _k {kinds[key]}, _f {kinds[fingerprint]}, _t {kinds[ts]}, _i {kinds[tie]}", ["_s", "_k"], keep)
    names = {"_s": session, "_k": key, "_f": fingerprint, "_t": ts, "_i": tie}

    def step(batch: DataFrame, epoch: int) -> None:
        before = table.read(before=epoch).select(*[F.col(c).alias(f"_last{c}") for c in names])
        same = C.quoted(session).eqNullSafe(F.col("_last_s")) & C.quoted(key).eqNullSafe(F.col("_last_k"))
        met = batch.join(before.withColumn("_known", F.lit(True)), same, "left")
        last = F.struct(F.col("_last_t").alias("t"), F.col("_last_i").alias("i"))
        fresh = met.filter(F.col("_known").isNull() | (F.struct(C.quoted(ts).alias("t"), C.quoted(tie).alias("i")) > last)).select(*batch.columns)
        touched = before.join(batch.select(C.quoted(session).alias("_s"), C.quoted(key).alias("_k")).distinct(),
                              F.col("_s").eqNullSafe(F.col("_last_s")) & F.col("_k").eqNullSafe(F.col("_last_k")), "left_semi")
        seeds = touched.select(*[F.col(f"_last{c}").alias(n) for c, n in names.items()])
        both = fresh.withColumn("_seed", F.lit(False)).unionByName(seeds.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
        kept = event_dedup_once(both, session, key, fingerprint, ts, tie, unit).filter("NOT _seed").drop("_seed")
        kept.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")
        at = F.struct(C.quoted(ts), C.quoted(tie))
        ends = fresh.groupBy(C.quoted(session).alias("_s"), C.quoted(key).alias("_k")).agg(
            F.max_by(F.struct(*[C.quoted(n).alias(c) for c, n in names.items() if c in ("_f", "_t", "_i")]), at).alias("e"))
        table.merge(ends.select("_s", "_k", "e.*"), epoch)

    query = (events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start())
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select(*events.columns)
