"""Subtotals, moving sums, joins by time and row differences against plain loops."""

import datetime as dt
import random
from collections import Counter

import pytest

from tallyframe.operators import row_diff, subtotals as S, temporal_joins as T
from tallyframe.operators.business import Fields

START = dt.datetime(2024, 1, 1)
FIELDS = Fields(date="d", amount="v")


def moments(rng, n, days, hot=0.5):
    """(key, time, number): a hot key, missing keys and times, ties."""
    out = []
    for i in range(n):
        key = None if rng.random() < 0.05 else 0 if rng.random() < hot else rng.randrange(1, 6)
        at = None if rng.random() < 0.05 else START + dt.timedelta(hours=rng.randrange(24 * days))
        out.append((key, at, i))
    return out


@pytest.mark.parametrize("within, hours", [(None, 24), ("3 days", 24), (None, 1), ("90 minutes", 500)])
def test_as_of_join(spark, within, hours):
    rng = random.Random(5)
    left, right = moments(rng, 300, 60), moments(rng, 120, 60, 0.3)
    left += left[:5]  # repeated rows stay
    age = {None: dt.timedelta.max, "3 days": dt.timedelta(days=3), "90 minutes": dt.timedelta(minutes=90)}[within]
    got = T.as_of_join(spark.createDataFrame(left, "k int, t timestamp_ntz, id int"), spark.createDataFrame(right, "k int, at timestamp_ntz, n int"),
                       ["k"], "t", "at", ["n"], within=within, bucket_hours=hours)
    want = []
    for k, t, i in left:
        fit = [] if k is None or t is None else [(at, n) for q, at, n in right if q == k and at is not None and at <= t]
        best = max(fit, default=None)
        want.append((k, t, i, best[1] if best and (age == dt.timedelta.max or t - best[0] <= age) else None))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_as_of_ties_and_null_values(spark):
    left = spark.createDataFrame([("a", START)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", START, 1, "x"), ("a", START, 2, None), ("a", START - dt.timedelta(days=9), 9, "z")],
                                  "k string, t timestamp_ntz, version int, label string")
    assert T.as_of_join(left, right, ["k"], "t", "t", ["label"], ties=["version"]).first()["label"] is None  # the newest, though null
    with pytest.raises(ValueError):
        T.as_of_join(left, right, ["k"], "t", "t", ["t"])


@pytest.mark.parametrize("hours", [1, 24])
def test_range_join(spark, hours):
    rng = random.Random(7)
    left, right = moments(rng, 250, 400), []
    for k, at, i in moments(rng, 80, 400):
        length = rng.choice([0, 1, 30, 24 * 20, 24 * 300])
        right.append((k, at, at + dt.timedelta(hours=length) if at and rng.random() < 0.8 else None, i))
    right.append((0, START + dt.timedelta(days=9), START, 999))  # ends before it starts
    df = spark.createDataFrame(right, "k int, a timestamp_ntz, b timestamp_ntz, n int")
    got = T.range_join(spark.createDataFrame(left, "k int, t timestamp_ntz, id int"), df, ["k"], "t", "a", "b", ["n"], hours)
    want = Counter((k, t, i, n) for k, t, i in left for q, a, b, n in right
                   if k is not None and k == q and t is not None and (a is None or a <= t) and (b is None or t < b) and (a is None or b is None or a < b))
    assert Counter(map(tuple, got.collect())) == want and any(r[1] is None for r in right)


def test_no_rows(spark):
    left = spark.createDataFrame([], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, START, START, 3)], "k int, a timestamp_ntz, b timestamp_ntz, n int")
    assert T.as_of_join(left, right, ["k"], "t", "a", ["n"]).collect() == []
    assert T.range_join(left, right, ["k"], "t", "a", "b", ["n"]).collect() == []
    asked = spark.createDataFrame([(1, START)], "k int, t timestamp_ntz")
    assert T.range_join(asked, right.limit(0), ["k"], "t", "a", "b", ["n"]).collect() == []
    assert [tuple(r) for r in T.as_of_join(asked, right.limit(0), ["k"], "t", "a", ["n"]).collect()] == [(1, START, None)]
    empty = spark.createDataFrame([], "d timestamp_ntz, g string, v double")
    assert [tuple(r) for r in S.dimension_rollup(empty, "d", ["g"], "amount", FIELDS).collect()] in ([], [(None, None, "total", 0.0)])
    assert S.moving_metric(empty, "d", "amount", FIELDS).collect() == []
    assert tuple(row_diff.diff_summary(empty, empty).first()) == (0, 0, 0, 0, 0, 0)


def test_rollup_tells_missing_from_subtotal(spark):
    df = spark.createDataFrame([(START, "x", 1.0), (START, None, 2.0), (START, None, 4.0), (None, "x", 8.0)], "d timestamp_ntz, g string, v double")
    got = {tuple(r) for r in S.dimension_rollup(df, "d", ["g"], "amount", FIELDS).collect()}
    assert got == {("2024-01", "x", "period+g", 1.0), ("2024-01", None, "period+g", 6.0), ("2024-01", None, "period", 7.0), (None, None, "total", 7.0)}
    with pytest.raises(KeyError):
        S.dimension_rollup(df, "d", ["g"], "amount", FIELDS, sets=[["nowhere"]])


def test_moving_sum_over_gaps(spark):
    days = [dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 31), dt.datetime(1969, 12, 30)]
    df = spark.createDataFrame([(d, float(2 ** i)) for i, d in enumerate(days)], "d timestamp_ntz, v double")
    weeks = {r["period"][:10]: (r["moving_sum"], r["present_periods"]) for r in S.moving_metric(df, "d", "amount", FIELDS, "week", 3).collect()}
    assert weeks == {"1969-12-29": (8.0, 1), "2024-01-01": (1.0, 1), "2024-01-08": (3.0, 2), "2024-01-29": (4.0, 1)}
    with pytest.raises(ValueError):
        S.moving_metric(df, "d", "unit_price", FIELDS)


def test_row_differences(spark):
    rng = random.Random(3)
    a, b = ([(rng.choice([None, 1, 2]), rng.choice(["x", None])) for _ in range(n)] for n in (40, 25))
    left, right = spark.createDataFrame(a, "n_left int, s string"), spark.createDataFrame(b, "n_left int, s string")
    ca, cb = Counter(a), Counter(b)
    changed = {(r[0], r[1]): (r["removed"], r["added"]) for r in row_diff.rows_changed(left, right).collect()}
    assert changed == {k: ((ca - cb)[k], (cb - ca)[k]) for k in ca | cb if ca[k] != cb[k]}
    assert {(r[0], r[1]): r["common"] for r in row_diff.rows_common(left, right).collect()} == dict(ca & cb)
    assert row_diff.diff_summary(left, right).first()["unchanged"] == sum((ca & cb).values())
    with pytest.raises(ValueError):
        row_diff.row_counts(left, right)  # n_left is one of its results
