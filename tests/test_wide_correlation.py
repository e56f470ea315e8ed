"""Many columns: the values of pandas, from a number of shuffles that does not grow with the pairs."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import correlation as R


def table(rows, width, seed, holes):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 4))
    frame = pd.DataFrame({f"c{i}": np.round(base @ rng.normal(size=4) * 3 + rng.normal(size=rows) * 2, i % 3) + 1e6 * (i % 2) for i in range(width)})
    together = rng.random(rows) < 0.2
    for i in range(width):
        if holes == "some" and i % 4 == 1:
            frame.loc[rng.random(rows) < 0.3, f"c{i}"] = np.nan
        if holes == "some" and i % 4 == 2:
            frame.loc[together, f"c{i}"] = np.nan
        if holes == "all":
            frame.loc[rng.random(rows) < 0.3, f"c{i}"] = np.nan
    return frame


def wanted(frame, method):
    out = {}
    for a, b in combinations(frame.columns, 2):
        both = frame[[a, b]].dropna()
        x, y = (both[a].rank(), both[b].rank()) if method == "spearman" else (both[a], both[b])
        constant = len(both) == 0 or x.nunique() < 2 or y.nunique() < 2
        out[a, b] = (None if constant else x.corr(y), len(both))
    return out


def check(got, want):
    rows = {(r["field_a"], r["field_b"]): r for r in got.collect()}
    assert set(rows) == set(want)
    for pair, (value, size) in want.items():
        assert rows[pair]["sample_size"] == size
        assert rows[pair]["correlation"] is None if value is None else math.isclose(rows[pair]["correlation"], value, abs_tol=1e-9), pair


def as_spark(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in frame.columns)).repartition(5)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("width, holes", [(12, "none"), (12, "some"), (9, "all"), (3, "some")])
def test_values_of_pandas(spark, method, width, holes):
    frame = table(400, width, width, holes)
    check(R.raw_pairs(as_spark(spark, frame), list(frame.columns), method), wanted(frame, method))


def test_fifty_columns_share_their_lists(spark):
    frame = table(300, 50, 1, "some")
    df = as_spark(spark, frame)
    check(R.raw_pairs(df, list(frame.columns)), wanted(frame, "pearson"))
    got = R.raw_pairs(df, list(frame.columns), "spearman")
    check(got, wanted(frame, "spearman"))
    few = R.raw_pairs(df, list(frame.columns[:4]), "spearman")
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (got, few)]
    assert plans[0].count("Join") == plans[1].count("Join") and plans[0].count("Aggregate") == plans[1].count("Aggregate")


def test_lists_are_shared(spark):
    df = as_spark(spark, table(200, 8, 2, "none"))
    kept = df.selectExpr("*", "monotonically_increasing_id() AS _row")
    lists, places = R._rank_lists(kept, df.columns)
    assert lists == [(c, None) for c in df.columns] and len(places) == 28
    holes = df.selectExpr(*[f"CASE WHEN c0 > 0 THEN c{i} END AS c{i}" if i in (1, 2, 3) else f"c{i}" for i in range(8)]).selectExpr("*", "monotonically_increasing_id() AS _row")
    lists, _ = R._rank_lists(holes, df.columns)
    assert len(lists) == 8 + 5  # c1 to c3 miss the same rows: their own lists serve all, the five others need one list more


def test_constants_and_empty_columns(spark):
    frame = pd.DataFrame({f"c{i}": [float(j * i % 7) for j in range(40)] for i in range(1, 8)})
    frame["same"], frame["big"] = 3.0, 1e15 + 0.25
    df = as_spark(spark, frame)
    for method in ("pearson", "spearman"):
        check(R.raw_pairs(df, list(frame.columns), method), wanted(frame, method))
        assert {r["correlation"] for r in R.raw_pairs(df.limit(0), list(frame.columns), method).collect()} == {None}
