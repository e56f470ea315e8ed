"""United sketches against exact profiles, and the names that discovery reads."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import joins as J, outliers as O, profiling as P, sketches as S


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(6)
    rows = [(f"2024-01-{d + 1:02d}", rng.randint(0, 4000), rng.choice([None, float("nan"), rng.gauss(10, 5)]), rng.choice(["a", "b", None]), {"k": rng.randint(0, 3)})
            for d in range(6) for _ in range(2500 if d else 6000)]
    return spark.createDataFrame(rows, "day string, id int, v double, s string, m map<string,int>").repartition(5)


def test_profile_of_a_new_day_reads_that_day_only(spark, days, tmp_path):
    path = str(tmp_path / "sketches")
    old, new = days.filter("day < '2024-01-06'"), days.filter("day = '2024-01-06'")
    S.store_sketches(S.partition_sketches(old, ["day"]), path, ["day"])
    before = {r["column"]: r["missing_count"] for r in S.sketched_profile(S.stored_sketches(spark, path)).collect()}
    assert before == {r["column"]: r["missing_count"] for r in P.field_profile(old.drop("day")).collect()}
    for _ in range(2):  # a day that is added again counts once
        S.store_sketches(S.partition_sketches(new, ["day"]), path, ["day"])
    stored = S.stored_sketches(spark, path)
    assert stored.count() == 6 * 4
    exact = {r["column"]: r for r in P.field_profile(days.drop("day")).collect()}
    for r in S.sketched_profile(stored).collect():
        want = exact[r["column"]]
        assert (r["dtype"], r["missing_count"]) == (want["dtype"], want["missing_count"])
        assert r["missing_pct"] == pytest.approx(want["missing_pct"])
        assert abs(r["distinct_count"] - want["distinct_count"]) <= 3 * r["distinct_error"] * want["distinct_count"]
    low_high = {r["column"]: (r["low"], r["high"]) for r in S.sketched_profile(stored).collect()}
    want = days.filter("NOT isnan(v)").agg(F.min("v"), F.max("v")).first()
    assert low_high["v"] == tuple(want) and low_high["s"] == (None, None)


def test_quartiles_within_the_stated_rank(spark, days):
    bounds = {r["column"]: r for r in S.sketched_iqr_bounds(S.partition_sketches(days, ["day"])).collect()}
    assert set(bounds) == {"id", "v"}
    exact = {r["column"]: r for r in O.iqr_bounds(days, ["id", "v"]).collect()}
    for c, b in bounds.items():
        values = sorted(r[0] for r in days.select(c).collect() if r[0] is not None and r[0] == r[0])
        for share, q in ((0.25, "q1"), (0.75, "q3")):
            assert sum(x < b[q] for x in values) / len(values) <= share + b["rank_error"]
            assert sum(x <= b[q] for x in values) / len(values) >= share - b["rank_error"]
        assert b["lower_bound"] == b["q1"] - 1.5 * b["iqr"] and abs(b["q1"] - exact[c]["q1"]) < 0.05 * exact[c]["iqr"] * 2


def test_groups_can_be_united_by_coarser_keys(spark, days):
    fine = S.partition_sketches(days.withColumn("half", F.col("day") < "2024-01-04"), ["half", "day"])
    coarse = {(r["half"], r["column"]): r["rows"] for r in S.united(fine, ["half"]).collect()}
    assert coarse[True, "v"] == 11000 and coarse[False, "v"] == 7500


def test_empty_columns_and_tables(spark):
    df = spark.createDataFrame([("d", None, None)], "day string, v double, s string")
    profile = {r["column"]: r for r in S.sketched_profile(S.partition_sketches(df, ["day"])).collect()}
    assert profile["v"]["missing_count"] == 1 and profile["v"]["distinct_count"] == 0 and profile["v"]["low"] is None
    assert S.sketched_iqr_bounds(S.partition_sketches(df, ["day"])).collect() == []
    assert S.sketched_profile(S.partition_sketches(df.limit(0), ["day"])).collect() == []


def test_wide_texts_are_counted_by_digest(spark):
    long = "x" * 70
    dates = [" " * 70 + "2024-01-05", "2024-01-05", "2024-02-01 10:00:00" + " " * 80]
    rows = [(long + str(i % 30), dates[i % 3], "short" if i % 2 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "wide string, date string, s string")
    got = {r["column"]: r for r in P.column_profile(df, dates=["wide", "date"]).collect()}
    one = {r["column"]: r for r in P.column_profile(df, distinct="none", dates=["wide", "date"]).collect()}
    assert {c: r["distinct_count"] for c, r in got.items()} == {"wide": 30, "date": 3, "s": 1}
    assert all(got[c]["parsed"] == one[c]["parsed"] and got[c]["non_null"] == one[c]["non_null"] for c in got)


def test_discovery_profiles_shared_names_only(spark, monkeypatch):
    orders = spark.createDataFrame([(i, i % 7, "long note") for i in range(40)], "order_id int, Customer_ID int, note string")
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "customer_id int, name string")
    lonely = spark.createDataFrame([(1, 2)], "p int, q int")
    tables = {"orders": orders, "customers": customers, "lonely": lonely}
    assert J.shared_names(tables) == {"orders": ["Customer_ID"], "customers": ["customer_id"]}
    whole = J.discover_relationships({n: J.relationship_profile(t) for n, t in tables.items()}).collect()
    read, real = [], P.column_profile
    monkeypatch.setattr(P, "column_profile", lambda df, *a, **k: read.append(df.columns) or real(df, *a, **k))
    assert J.discover_in_tables(tables).collect() == whole and len(whole) == 1
    assert read and all(set(c) <= {"Customer_ID", "customer_id"} for c in read)
    assert J.discover_in_tables({"a": lonely}).collect() == [] and J.discover_in_tables({"a": lonely, "b": orders}).collect() == []
