"""Joins by time: the newest row up to a moment, and the rows that are valid at a moment. Time is cut into buckets, so a key
with very many rows is spread over tasks, and no rows meet but those of one key and bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions import columns as C

BUCKET_HOURS = 24
FAN = 16  # an interval covers at most FAN + 1 buckets of its level
LEVELS = 6  # the widest buckets are FAN ** 5 of the narrowest


def _hour(ts: Column) -> Column:
    """Hours since 1970 on the calendar; no time zone is involved."""
    return F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")) * F.lit(24).cast("bigint") + F.hour(ts)


def _whole(columns: Sequence[Column]) -> Column:
    """True where none of the columns is missing."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def _check(left: DataFrame, columns: Sequence[str]) -> None:
    if clash := sorted(set(columns) & set(left.columns)):
        raise ValueError(f"columns on both sides: {', '.join(clash)}; rename them first")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str],
               ties: Sequence[str] = (), within: str | None = None, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """All rows of left, with ``columns`` of the newest right row of the same keys whose time is not later.

    Of right rows with one time the largest ``ties`` win, then the largest ``columns``. ``within`` ("7 days") bounds the age.
    Left rows without a match, with a missing key or without a time have null columns; right rows with a missing key or time
    match nothing. Repeated left rows stay. Both sides are read as one stream ordered by time inside (keys, bucket); what a
    bucket inherits comes from one row for each key and bucket.
    """
    _check(left, columns)
    names = [f"_k{i}" for i in range(len(keys))]
    found = F.struct(C.quoted(right_time).cast("timestamp_ntz").alias("_at"), F.struct(F.lit(0), *map(C.quoted, ties)).alias("_ties"),
                     F.struct(F.lit(0).alias("_0"), *map(C.quoted, columns)).alias("_row"))
    moments = right.select(*[C.quoted(k).alias(n) for k, n in zip(keys, names)], found.alias("_found")).filter(
        _whole([F.col(n) for n in names]) & F.col("_found._at").isNotNull())
    kind = moments.schema["_found"].dataType
    asked = left.select(*[C.quoted(k).alias(n) for k, n in zip(keys, names)], F.struct(*map(C.quoted, left.columns)).alias("_left"),
                        C.quoted(left_time).cast("timestamp_ntz").alias("_time"))
    usable = _whole([*[F.col(n) for n in names], F.col("_time")])
    shape = [*names, "_left", "_time", "_found"]
    stream = asked.filter(usable).withColumn("_found", F.lit(None).cast(kind)).select(*shape).union(
        moments.select(*names, F.lit(None).cast(asked.schema["_left"].dataType), F.col("_found._at"), "_found"))
    stream = stream.withColumn("_bucket", F.floor(_hour(F.col("_time")) / F.lit(bucket_hours)))
    place = [*names, "_bucket"]
    upto = Window.partitionBy(*place).orderBy("_time", F.col("_left").isNotNull(), "_found").rowsBetween(Window.unboundedPreceding, 0)
    here = stream.withColumn("_here", F.last("_found", ignorenulls=True).over(upto)).filter("_left IS NOT NULL")
    # one row for each key and bucket; dealt like the stream, so that a hot key is not brought together by the join
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = stream.groupBy(*place).agg(F.max("_found").alias("_newest")).select(
        *place, F.last("_newest", ignorenulls=True).over(before).alias("_before")).repartition(*place)
    best = here.join(inherited, place, "left").withColumn("_best", F.coalesce("_here", "_before"))
    if within is not None:
        best = best.withColumn("_best", F.when(F.col("_best._at") >= F.col("_time") - F.expr(f"INTERVAL {within}"), F.col("_best")))
    alone = asked.filter(~usable).select("_left", F.lit(None).cast(kind).alias("_best"))
    return best.select("_left", "_best").union(alone).select("_left.*", *[F.col("_best._row").getField(c).alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, start: str, end: str, columns: Sequence[str],
               bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Pairs of a left row and a right row of the same keys with start <= time < end; left's columns and ``columns`` of right.

    A missing start or end is open. Left rows without a time or a key match nothing; overlapping intervals give a row each.
    An interval is written to at most FAN + 1 buckets of the narrowest level where it fits, a left row to one bucket of each
    level in use, so a pair meets once, long intervals do not multiply, and rows of one key meet by bucket only.
    """
    _check(left, columns)
    names = [f"_k{i}" for i in range(len(keys))]
    moment = C.quoted(time).cast("timestamp_ntz")
    asked = left.select(*[C.quoted(k).alias(n) for k, n in zip(keys, names)], F.struct(*map(C.quoted, left.columns)).alias("_left"),
                        moment.alias("_time")).filter(_whole([*[F.col(n) for n in names], F.col("_time")]))
    low, high = asked.agg(F.min("_time"), F.max("_time")).first()  # open ends reach as far as the left rows
    valid = right.select(*[C.quoted(k).alias(n) for k, n in zip(keys, names)], C.quoted(start).cast("timestamp_ntz").alias("_start"),
                         C.quoted(end).cast("timestamp_ntz").alias("_end"), F.struct(F.lit(0).alias("_0"), *map(C.quoted, columns)).alias("_right"))
    low, high = F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")
    valid = valid.filter(_whole([F.col(n) for n in names])).withColumns({
        "_from": F.greatest("_start", low), "_to": F.least("_end", high)}).filter(
        (F.col("_from") <= F.col("_to")) & F.coalesce(F.col("_start") < F.col("_end"), F.lit(True)))
    widths = [bucket_hours * FAN ** level for level in range(LEVELS)]
    first, last, level = _hour(F.col("_from")), _hour(F.col("_to")), F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(last - first < widths[i] * FAN, i).otherwise(level)
    width = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in widths]), F.col("_level") + 1)
    valid = valid.withColumn("_level", level)
    levels = [r["_level"] for r in valid.select("_level").distinct().collect()]  # at most LEVELS
    valid = valid.withColumn("_bucket", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    asked = asked.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>"))).withColumn(
        "_bucket", F.floor(_hour(F.col("_time")) / width))
    inside = F.coalesce(F.col("_start") <= F.col("_time"), F.lit(True)) & F.coalesce(F.col("_time") < F.col("_end"), F.lit(True))
    return asked.join(valid, [*names, "_level", "_bucket"]).filter(inside).select(
        "_left.*", *[F.col("_right").getField(c).alias(c) for c in columns])
