"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives as module
from tallyframe.llm.hard_negatives import MultiIndex, fit_codes, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives, negatives, low, high, scale):
    good = [(i, np.floor(scale * np.array(v, dtype=np.float32).astype(np.float64)).astype(object), l) for i, v, l in rows
            if i is not None and l is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    out = []
    for a, x, mine in good:
        if not is_anchor(a):
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, l == mine) for i, y, l in good if i != a)
        for less, p, _ in [s for s in scores if s[2]][:positives]:
            hits = [(n, i) for n, i, same in scores if not same and low * -less <= -100 * n <= high * -less][:negatives]
            out += [(a, p, k + 1, i, int(-less), int(-n)) for k, (n, i) in enumerate(hits)]
    return sorted(out)


def clusters(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 3
    return [(i, [float(x) for x in centres[i % 12] + rng.normal(size=width) * 0.3], int(rng.integers(0, 3))) for i in range(n)]


ODD = [(5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan"), 1.0], 1), (5003, [float("inf"), 1.0], 1), (5010, [1.0, 1.0], None),
       (None, [1.0, 1.0], 1), (5020, [], 1), (5030, [2.5], 2), (5040, [0.0] * 9, 0)]


@pytest.mark.parametrize("blocks", [4096, 7])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(module, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(module, "FIRST_CELLS", 2)
    rng = np.random.default_rng(3)
    ties = [(1000 + i, [float(x) for x in rng.integers(-2, 3, 6) / 2], i % 4) for i in range(150)]
    rows = clusters(200, 6, 1) + ties + ODD
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cell", "2 AS draw", "3 AS values", "4 AS windows", "5 AS wanted").repartition(4)
    for args in ((5, 10, 30, 90), (2, 3, 80, 100)):
        got = sorted(tuple(r) for r in mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, *args, scale=16).collect())
        assert got == plain(rows, lambda i: i % 10 == 0, *args, 16) and got


def test_a_repeated_row_counts_for_others(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.5, 0.0], 1), (3, [0.5, 0.0], 1), (1, [0.6, 0.0], 1)]
    got = sorted(tuple(r)[:4] for r in mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 1, scale=100).collect())
    assert got == [(1, 2, r, 3) for r in (1, 1, 2, 2)]  # the second row 1 is an anchor of label 1, whose rows 3 have no negative in reach


def test_bounds_hold_and_fall():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(400, 7)) * 50)
    index = MultiIndex(7, tuple(fit_codes(h, 6) for h in MultiIndex(7, ()).halves(x)))
    own = [((h[:, None, :] - c[None]) ** 2).sum(-1) for h, c in zip(index.halves(x), index.codes)]
    index.radii = tuple(np.array([np.sqrt(d[d.argmin(1) == k, k].max(initial=0)) for k in range(d.shape[1])]) for d in own)
    cell = own[0].argmin(1) * module.MOST_CODES + own[1].argmin(1)
    index.parts = dict.fromkeys(cell.tolist(), 1)
    for q in x[:20]:
        order = list(index.cells(q))
        assert [c for *_, c in order] and sorted(c for *_, c in order) == sorted(index.parts)
        highs = [h for h, *_ in order]
        assert highs == sorted(highs, reverse=True)
        for high, low, c in order:
            score = x[cell == c] @ q
            assert low <= score.min() and score.max() <= high


def test_far_cells_are_not_visited(spark, monkeypatch):
    seen = []
    real = module.certified
    monkeypatch.setattr(module, "FIRST_CELLS", 2)
    monkeypatch.setattr(module, "certified", lambda index, visited, k: seen.append((visited, len(index.parts))) or real(index, visited, k))
    rows = [(i, [float(v) for v in np.eye(8)[i % 4] * 10 + np.eye(8)[4 + i % 4] * 10], i // 4 % 2) for i in range(400)]
    got = sorted(tuple(r) for r in mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 100, 5, 10, 30, 100, scale=4).collect())
    assert got == plain(rows, lambda i: i == 100, 5, 10, 30, 100, 4)
    assert max(v for v, _ in seen) < min(n for _, n in seen)


def test_no_rows_and_overlong_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine_hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []
    assert mine_hard_negatives(spark.createDataFrame(ODD, SCHEMA), F.col("vec_id") == 1).collect() == []
    with pytest.raises(Exception, match="too long"):
        mine_hard_negatives(spark.createDataFrame([(1, [1e18], 1)], SCHEMA), F.col("vec_id") == 1).collect()
