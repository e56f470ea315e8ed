"""Audits from the job that writes: equal to counting each step, one write for a plan that measures nothing."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.cleaning import compare_before_after
from tallyframe.operators import profiling as P
from tallyframe.plans import cleaning_plan as module
from tallyframe.plans.cleaning_plan import ObservedPlan, Step, active, apply_step, audited_plan, clean_dataset

COUNTED = [Step("drop_missing_rows", columns=("v",)), Step("fill", column="s", method="unknown"), Step("drop_duplicates"),
           Step("drop_columns", columns=("gone",)), Step("drop_rows", row_ids=(3, 4, 5), key="id"), Step("fill", column="w", method="zero")]
MEASURED = [Step("outlier", column="v", method="drop_rows"), Step("drop_missing_rows", columns=("w",)), Step("fill", column="v", method="median"),
            Step("drop_duplicates"), Step("fill", column="s", method="mode"), Step("drop_high_missing", threshold=0.9), Step("outlier", column="w", method="winsorize")]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i // 3, rng.choice([None, 1.0, 2.0, 3.0, 900.0]), rng.choice([None, 5.0, 6.0]), rng.choice(["a", "b", "", None]), None, 1) for i in range(900)]
    return spark.createDataFrame(rows, "id int, v double, w double, s string, empty double, gone int").repartition(7)


def counted(df, steps):
    """The audit by counting every step's plan."""
    out = []
    for i, step in enumerate(active(steps), 1):
        after = apply_step(df, step)
        gone = [c for c in df.columns if c not in after.columns]
        out.append((i, step.kind, step.column or ",".join(step.columns) or None, step.method, df.count(), len(P.data_columns(df)), after.count(),
                    len(P.data_columns(after)), ",".join(gone)))
        df = after
    return df, out


@pytest.mark.parametrize("steps, writes", [(COUNTED, 1), (MEASURED, 6), (MEASURED[:2], 2), (MEASURED[2:3], 1), (COUNTED[1:2], 1), ([], 0), ([Step("none")], 0)])
@pytest.mark.parametrize("again", [False, True])
def test_audit_equals_counting(spark, table, monkeypatch, steps, writes, again):
    if again:  # as after a lost executor
        monkeypatch.setattr(module, "once_only", lambda *_: False)
    want_frame, want = counted(table, steps)
    frame, audit = audited_plan(table, steps)
    assert [tuple(r) for r in audit.collect()] == want
    assert sorted(map(str, frame.collect())) == sorted(map(str, want_frame.collect()))
    plan = ObservedPlan(table, steps)
    if plan.pending:
        plan.run(lambda: plan.frame.write.format("noop").mode("overwrite").save())
    assert plan.writes <= writes and [tuple(r) for r in plan.audit().collect()] == want


def test_a_plan_is_written_once(spark, table, tmp_path, monkeypatch):
    def no(*_):
        raise AssertionError("a plan without a measured step needs no table in between")
    monkeypatch.setattr(module, "cut_lineage", no)
    audit = clean_dataset(table, COUNTED, str(tmp_path / "out")).orderBy("step").collect()
    want_frame, want = counted(table, COUNTED)
    assert [tuple(r)[:-1] for r in audit] == want
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out" / "data")).select(want_frame.columns).collect())) == sorted(map(str, want_frame.collect()))


def test_the_job_group_of_the_caller_comes_back(spark, table):
    context = spark.sparkContext
    context.setJobGroup("mine", "of the caller")
    try:
        audited_plan(table, COUNTED)
        assert context.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def test_before_and_after_from_one_shuffle(spark, table):
    got = {r["metric"]: (r["before"], r["after"]) for r in compare_before_after(table, table.filter("v IS NOT NULL").drop("gone")).collect()}

    def sheet(df):
        missing = sum(df.filter(F.col(c).isNull()).count() for c in df.columns)
        return df.count(), len(df.columns), missing, df.count() - df.distinct().count()
    before, after = sheet(table), sheet(table.filter("v IS NOT NULL").drop("gone"))
    assert got == dict(zip(("rows", "columns", "missing_values", "duplicate_rows"), zip(before, after)))
    empty = table.limit(0)
    assert {r["before"] for r in compare_before_after(empty, empty).collect()} == {0, 6}
