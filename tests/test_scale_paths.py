"""The ways taken only by large inputs, forced on small ones and compared with brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import categories as G, correlation as K, events as E, profiling as P, questions as Q
from tallyframe.operators.quantiles import exact_quantiles
from tallyframe.operators.ranking import with_global_order
from tallyframe.session import cut_lineage


@pytest.mark.parametrize("kind", ["smooth", "ties", "one_third_hot", "two_masses", "constant", "heavy_tail"])
def test_narrowed_quantiles(spark, kind):
    rng = np.random.default_rng(7)
    n = 20_001
    values = {
        "smooth": rng.normal(size=n), "ties": rng.integers(0, 30, n).astype(float),
        "one_third_hot": np.where(rng.random(n) < 0.34, 5.0, rng.random(n) * 10),
        "two_masses": np.where(rng.random(n) < 0.5, 1.0, 2.0), "constant": np.full(n, 3.0),
        "heavy_tail": np.exp(rng.normal(size=n) * 4),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 50, "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for bracket in (10, 500, 10**6):
        got = exact_quantiles(df, ["v"], probs, distinct_limit=0, bracket_limit=bracket)["v"]
        assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert exact_quantiles(df, ["v"], probs)["v"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_global_order_over_ranges(spark):
    rows = [(f"k{i % 977:04}{i}", (i * 7919) % 13 if i % 3 else 5) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k string, n int")
    got = with_global_order(df, [-F.col("n"), F.col("k")], "n", range_rows=250).collect()
    want, run = {}, 0
    for p, (k, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        run += n
        want[k] = (p, run)
    assert {r["k"]: (r["position"], r["running"]) for r in got} == want


def test_composition_over_ranges(spark):
    words = [f"w{int(random.Random(i).paretovariate(0.8)) % 3000}" for i in range(8_000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    a = G.category_composition(df, "w", range_rows=100).collect()
    b = G.category_composition(df, "w").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_spearman_against_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 3000).astype(float)
    y = x * 2 + rng.normal(size=3000) * 30
    pdf = pd.DataFrame({"x": x, "y": y})
    r = K.correlation_pairs(spark.createDataFrame(pdf), ["x", "y"], "spearman", 0.0).first()
    assert r["correlation"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-12) and r["sample_size"] == 3000
    ranks = {r["value"]: r["rank"] for r in K.spearman_ranks(spark.createDataFrame(pdf), "y", range_rows=100).collect()}
    assert ranks == dict(zip(pdf.y, pdf.y.rank()))


def test_dedup_with_a_hot_session(spark):
    rng, start = random.Random(5), dt.datetime(2026, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else rng.randint(2, 40), "page", rng.choice("ab"), start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 9)))
            for i in range(4_000)]
    df = spark.createDataFrame(rows, "id int, session int, key string, fp string, ts timestamp_ntz")
    for unit in ("hour", "day"):
        got = {r["id"] for r in E.event_dedup_once(df, "session", "key", "fp", "ts", "id", unit).collect()}
        state, want = {}, set()
        for i, s, k, fp, ts in sorted(rows, key=lambda r: (r[4], r[0])):
            if state.get((s, k)) != fp:
                want.add(i)
                state[(s, k)] = fp
        assert got == want


def test_question_values_by_join(spark):
    questions = spark.createDataFrame([(1, "North East sales"), (2, "East"), (3, None), (4, "")], "question_id int, question string")
    data = spark.createDataFrame([("East",), ("North East",), ("E",), ("West",)], "region string")
    for limit in (0, 100):
        got = sorted(map(tuple, Q.question_filters(questions, data, ["region"], list_limit=limit).collect()))
        assert got == [(1, "region", "North East"), (2, "region", "East")]


def test_top_values_and_samples(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    assert tuple(P.top_values(df, ["s"]).first()) == ("s", 3, "a", 2)
    big = spark.range(5000)
    one, two = P.sample_rows(big, 20).collect(), P.sample_rows(big.repartition(7), 20).collect()
    assert len(set(one)) == 20 and sorted(one) == sorted(two)
    assert sorted(P.sample_rows(big, 20, seed=1).collect()) != sorted(one)


def test_reliable_checkpoint(spark):
    df = cut_lineage(spark.range(100).withColumn("_row_id", F.monotonically_increasing_id()))
    assert df.count() == 100 and df.select("_row_id").distinct().count() == 100
