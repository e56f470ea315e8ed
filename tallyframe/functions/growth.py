"""Growth between two values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def growth_percent(current: Column, previous: Column) -> Column:
    """(cur - prev) / |prev| * 100; NULL without a non-zero previous value."""
    cur, prev = current.cast("double"), previous.cast("double")
    return F.when(prev != 0, (cur - prev) / F.abs(F.nullif(prev, F.lit(0.0))) * 100)


def growth_fraction(current: Column, previous: Column) -> Column:
    """(cur - prev) / prev with the sign of prev kept."""
    cur, prev = current.cast("double"), previous.cast("double")
    return F.when(prev != 0, (cur - prev) / F.nullif(prev, F.lit(0.0)))


def share_percent(part: Column, total: Column) -> Column:
    """part / total * 100, 0 when the total is 0 or missing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        part / F.nullif(total.cast("double"), F.lit(0.0)) * 100)
