"""Aggregate expressions whose results follow the sample (bias-corrected) definitions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(c: Column) -> Column:
    """G1; 0 for a constant, NULL below three values."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected)


def sample_kurtosis(c: Column) -> Column:
    """Excess G2; 0 for a constant, NULL below four values."""
    n = F.count(c).cast("double")
    scale = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = (n - 1) / scale * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected)


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson over rows where both sides are present; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    mx, my = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(mx) * F.stddev_samp(my)
    return F.covar_samp(mx, my) / F.nullif(spread, F.lit(0.0))


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))
