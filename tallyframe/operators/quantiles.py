"""Exact quantiles (linear interpolation) that stay exact and bounded at any size.

The built-in ``percentile`` keeps a value->count map of the whole column in one task. Here the values are counted by
groups instead, and only values near the wanted ranks are ranked. A column with few distinct values is counted whole.
For the others ``percentile_approx`` gives a bracket around each rank, one counting pass confirms it, and the bracket
is narrowed until the values inside fit ``bracket_limit``. All columns and ranks share each pass, every pass is a
partial aggregate, and only a few numbers per column come back to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.columns import as_double
from tallyframe.operators.ranking import with_global_order

DISTINCT_LIMIT = 200_000
BRACKET_LIMIT = 1_000_000
ACCURACY = 2_000
SLACK = 2.0 / ACCURACY
INF = float("inf")


@dataclass
class _Target:
    """One wanted rank: order statistics k and k+1 of column i, known to lie within [lo, hi]."""

    i: int
    prob: float
    n: int
    lo: float = -INF
    hi: float = INF
    below: int = 0
    inside: int = 0
    stuck: bool = False

    def __post_init__(self):
        position = (self.n - 1) * self.prob
        self.k = math.floor(position)
        self.upper = min(self.k + 1, self.n - 1)
        self.fraction = position - self.k
        self.inside = self.n

    def held(self) -> Column:
        v = F.col(f"v{self.i}")
        return (v >= F.lit(self.lo)) & (v <= F.lit(self.hi))

    def probes(self) -> list[float]:
        return [max(0.0, (self.k - self.below) / self.inside - SLACK),
                min(1.0, (self.upper - self.below + 1) / self.inside + SLACK)]

    def narrow(self, a: float, b: float, under: int, within: int) -> None:
        """Take the bracket [a, b]; where the estimate missed the rank, the old end is kept."""
        if self.below + under > self.k:
            a, within, under = self.lo, under + within, 0
        if self.below + under + within <= self.upper:
            b, within = self.hi, self.inside - under
        self.stuck = (a, b) == (self.lo, self.hi)
        self.lo, self.hi, self.below, self.inside = a, b, self.below + under, within


def exact_quantiles(df: DataFrame, columns: dict[str, Column] | list[str], probs: list[float],
                    distinct_limit: int | None = None, bracket_limit: int | None = None) -> dict[str, list[float | None]]:
    """{column: [value per prob]}; NULLs are left out, an empty column gives None."""
    distinct_limit = DISTINCT_LIMIT if distinct_limit is None else distinct_limit
    bracket_limit = BRACKET_LIMIT if bracket_limit is None else bracket_limit
    if not isinstance(columns, dict):
        columns = {c: as_double(df, c) for c in columns}
    if not columns:
        return {}
    names = list(columns)
    values = df.select(*[columns[c].alias(f"v{i}") for i, c in enumerate(names)])
    sizes = values.agg(*[x for i in range(len(names)) for x in (
        F.count(f"v{i}").alias(f"n{i}"), F.approx_count_distinct(f"v{i}").alias(f"d{i}"))]).first()
    filled = [i for i in range(len(names)) if sizes[f"n{i}"]]
    targets = [_Target(i, p, sizes[f"n{i}"]) for i in filled for p in probs]
    large = [t for t in targets if sizes[f"d{t.i}"] > distinct_limit]
    _narrow_down(values, large, bracket_limit)
    found = iter(_order_statistics(values, targets, bracket_limit, set(map(id, large))))
    return {c: [next(found) for _ in probs] if i in filled else [None] * len(probs) for i, c in enumerate(names)}


def _narrow_down(values: DataFrame, targets: list[_Target], limit: int) -> None:
    wide = targets
    while wide:
        shared: dict[tuple, list[_Target]] = {}  # ranks still within the same bracket share one sketch
        for t in wide:
            shared.setdefault((t.i, t.lo, t.hi), []).append(t)
        row = values.agg(*[
            F.percentile_approx(F.when(ts[0].held(), F.col(f"v{ts[0].i}")), [x for t in ts for x in t.probes()], ACCURACY)
            for ts in shared.values()]).first()
        ends = {id(t): got[2 * j:2 * j + 2] for ts, got in zip(shared.values(), row) for j, t in enumerate(ts)}
        _confirm(values, wide, [ends[id(t)] for t in wide])
        wide = [t for t in wide if t.inside > limit and t.lo < t.hi and not t.stuck]


def _order_statistics(values: DataFrame, targets: list[_Target], limit: int, large: set[int]) -> list[float]:
    pairs: dict[int, tuple[float, float]] = {j: (t.lo, t.lo) for j, t in enumerate(targets) if t.lo == t.hi}
    rest = {j: t for j, t in enumerate(targets) if j not in pairs}
    fitting = {j: t for j, t in rest.items() if id(t) not in large or t.inside <= limit}
    if fitting:
        pairs.update(_read_brackets(values, fitting))
    for j in rest.keys() - fitting.keys():  # masses of equal values kept the bracket wide
        pairs[j] = _read_wide(values, rest[j])
    return [pairs[j][0] + (pairs[j][1] - pairs[j][0]) * t.fraction for j, t in enumerate(targets)]


def _confirm(values: DataFrame, targets: list[_Target], ends: list) -> None:
    """Count what lies below and inside each estimated bracket, all brackets in one pass."""
    aggs = []
    for t, (a, b) in zip(targets, ends):
        v = F.col(f"v{t.i}")
        aggs += [F.count_if(t.held() & (v < F.lit(a))), F.count_if(t.held() & (v >= F.lit(a)) & (v <= F.lit(b)))]
    row = values.agg(*aggs).first()
    for j, (t, (a, b)) in enumerate(zip(targets, ends)):
        t.narrow(a, b, row[2 * j], row[2 * j + 1])


def _read_brackets(values: DataFrame, targets: dict[int, _Target]) -> dict[int, tuple[float, float]]:
    """Value counts inside the brackets, in one job; overlapping brackets of a column are read as one range."""
    ranges: list[tuple[int, float, float, int]] = []  # column, lo, hi, values below lo
    home: dict[int, int] = {}
    for j, t in sorted(targets.items(), key=lambda x: (x[1].i, x[1].lo, x[1].hi)):
        if ranges and ranges[-1][0] == t.i and t.lo <= ranges[-1][2]:
            i, lo, hi, below = ranges[-1]
            ranges[-1] = (i, lo, max(hi, t.hi), below)
        else:
            ranges.append((t.i, t.lo, t.hi, t.below))
        home[j] = len(ranges) - 1
    parts = []
    for i in sorted({r[0] for r in ranges}):
        v = F.col("v")
        own = [(g, lo, hi) for g, (c, lo, hi, _) in enumerate(ranges) if c == i]
        inside = F.coalesce(*[F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.lit(g)) for g, lo, hi in own])
        held = reduce(lambda x, y: x | y, [(v >= F.lit(lo)) & (v <= F.lit(hi)) for _, lo, hi in own])
        parts.append(values.select(F.col(f"v{i}").alias("v")).filter(held).groupBy(inside.alias("g"), "v").agg(
            F.count(F.lit(1)).alias("n")))
    running = reduce(DataFrame.unionByName, parts).withColumn(
        "upto", F.sum("n").over(Window.partitionBy("g").orderBy("v")))
    aggs = []
    for j, t in targets.items():
        here, start = F.col("g") == home[j], ranges[home[j]][3]
        aggs += [F.min(F.when(here & (F.col("upto") > t.k - start), F.col("v"))),
                 F.min(F.when(here & (F.col("upto") > t.upper - start), F.col("v")))]
    row = running.agg(*aggs).first()
    return {j: (row[2 * x], row[2 * x + 1]) for x, j in enumerate(targets)}


def _read_wide(values: DataFrame, target: _Target) -> tuple[float, float]:
    counted = values.filter(target.held()).groupBy(F.col(f"v{target.i}").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ordered = with_global_order(counted, [F.col("v")], "n", running="upto")
    row = ordered.agg(F.min(F.when(F.col("upto") > target.k - target.below, F.col("v"))),
                      F.min(F.when(F.col("upto") > target.upper - target.below, F.col("v")))).first()
    return row[0], row[1]


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 10_000):
    """One-pass opt-in for wide tables: same shape, values within n/accuracy ranks."""
    row = df.agg(*[F.percentile_approx(as_double(df, c), probs, accuracy).alias(f"q{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}


def literal(value: float | None) -> Column:
    return F.lit(None).cast("double") if value is None else F.lit(float(value))
