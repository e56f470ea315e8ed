"""A cleaning plan: ordered steps, what they did, and what they are expected to do."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import cleaning as K, outliers as O, profiling as P
from tallyframe.operators.quality import copy_groups
from tallyframe.session import cut_lineage

FILL_METHODS = ("zero", "mean", "median", "mode", "unknown", "custom")


@dataclass(frozen=True)
class Step:
    """kind: drop_missing_rows, drop_columns, drop_high_missing, fill, drop_duplicates, drop_rows, outlier."""

    kind: str
    column: str | None = None
    columns: tuple[str, ...] = ()
    method: str | None = None
    value: object = ""
    threshold: float = 0.8
    row_ids: tuple = ()
    key: str = P.ROW_ID


@dataclass(frozen=True)
class MissingChoice:
    """What to do about one column: drop_column, drop_rows, a fill method, or none."""

    column: str
    method: str = "none"
    fill_value: object = ""


@dataclass(frozen=True)
class DuplicateChoice:
    """none, drop_all or drop_selected (by row key)."""

    method: str = "none"
    row_ids: tuple = ()
    key: str = P.ROW_ID


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    if step.kind == "drop_missing_rows":
        return K.drop_missing_rows(df, list(step.columns) or ([step.column] if step.column else None))
    if step.kind == "drop_columns":
        return K.drop_columns(df, list(step.columns))
    if step.kind == "drop_high_missing":
        return K.drop_high_missing(df, step.threshold)
    if step.kind == "fill":
        return K.fill_missing(df, step.column, step.method, step.value)
    if step.kind == "drop_duplicates":
        return K.drop_duplicates(df)
    if step.kind == "drop_rows":
        return K.drop_rows_by_id(df, list(step.row_ids), step.key)
    if step.kind == "outlier":
        if step.method in (None, "keep"):
            return df
        if step.method not in O.TREATMENTS:
            raise ValueError(f"unknown outlier treatment {step.method!r}")
        return O.TREATMENTS[step.method](df, step.column)
    raise ValueError(f"unknown cleaning step {step.kind!r}")


def active(steps: list[Step]) -> list[Step]:
    return [s for s in steps if s.kind not in (None, "none")]


def apply_plan(df: DataFrame, steps: list[Step]) -> DataFrame:
    """The cleaned table as one lazy plan."""
    for step in active(steps):
        df = apply_step(df, step)
    return df


AUDIT_SCHEMA = ("step int, kind string, target string, method string, rows_before bigint, columns_before int, "
                "rows_after bigint, columns_after int, dropped_columns string")


JOB_GROUP = "spark.jobGroup.id"
MEASURED_FILLS = ("mean", "median", "mode")


def measures(step: Step) -> bool:
    """Whether the step reads the whole table before it can change it."""
    return step.kind in ("outlier", "drop_high_missing") or step.method in MEASURED_FILLS


def drops_rows(step: Step) -> bool:
    return step.kind in ("drop_missing_rows", "drop_duplicates", "drop_rows") or (
        step.kind == "outlier" and step.method == "drop_rows")


class ObservedPlan:
    """The cleaned table as one lazy plan that counts its rows while it runs, and its audit.

    Every row-dropping step is followed by an observed count, so the job that writes ``frame`` also gives the audit. The plan
    is materialised in between only where a step has to measure a table that earlier steps have changed.
    Observed counts are accumulators: a task that runs twice, after the loss of an executor, adds its rows twice. They
    are used only if no task of the job failed or was run again; else the steps' rows are counted from their plans.
    """

    def __init__(self, df: DataFrame, steps: list[Step]):
        self.spark, self.counts, self.entries, self.writes = df.sparkSession, [], [], 0
        self.pending: list[tuple[int, DataFrame, Observation]] = []
        self.frame, changed, now = df, False, None
        for i, step in enumerate(active(steps), 1):
            if measures(step) and changed:
                self.frame, changed = self._materialised(), False
            if drops_rows(step) and now is None:
                now = self._known(self.frame.count()) if measures(step) else self._observe(self.frame)
            after = apply_step(self.frame, step)
            gone = [c for c in self.frame.columns if c not in after.columns]
            entry = (i, step.kind, step.column or ",".join(step.columns) or None, step.method, len(P.data_columns(self.frame)),
                     len(P.data_columns(after)), ",".join(gone))
            before, self.frame = now, after
            if drops_rows(step):
                now = self._observe(self.frame)
            changed = changed or drops_rows(step) or measures(step)
            self.entries.append((entry, before, now))
        if self.entries and now is None:
            self._observe(self.frame)  # no step drops rows

    def _known(self, rows: int) -> int:
        self.counts.append(rows)
        return len(self.counts) - 1

    def _observe(self, frame: DataFrame) -> int:
        """Number of the count that the next job over ``frame`` gives."""
        seen = Observation()
        place = self._known(-1)
        self.pending.append((place, frame, seen))
        self.frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
        return place

    def _materialised(self) -> DataFrame:
        return self.run(lambda: cut_lineage(self.frame))

    def run(self, action: Callable):
        """Carries out an action over ``frame`` and takes its counts."""
        context, group = self.spark.sparkContext, f"observed-{uuid.uuid4().hex}"
        outer = context.getLocalProperty(JOB_GROUP)
        context.setLocalProperty(JOB_GROUP, group)
        try:
            result = action()
        finally:
            context.setLocalProperty(JOB_GROUP, outer)
        self.writes += 1
        seen = {place: seen.get["rows"] for place, _, seen in self.pending}
        certain = once_only(context, group)
        for place, frame, _ in self.pending:
            self.counts[place] = seen[place] if certain else frame.count()
        self.pending = []
        return result

    def audit(self) -> DataFrame:
        """AUDIT_SCHEMA, after run()."""
        if self.pending:
            raise ValueError("the audit is known after run()")
        first = self.counts[0] if self.counts else None
        rows = [(i, kind, target, method, self.counts[b] if b is not None else first, wide, self.counts[a] if a is not None else first, wide_after, gone)
                for (i, kind, target, method, wide, wide_after, gone), b, a in self.entries]
        return self.spark.createDataFrame(rows, AUDIT_SCHEMA)


def once_only(context: SparkContext, group: str) -> bool:
    """Whether every task of a group's jobs ran once."""
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for job in jobs if job is not None for s in job.stageIds]
    return bool(jobs) and all(s is not None and s.currentAttemptId == 0 and s.numFailedTasks == 0 for s in stages)


def audited_plan(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, materialised once, and its audit from the same job."""
    plan = ObservedPlan(df, steps)
    frame = plan.run(lambda: cut_lineage(plan.frame)) if plan.pending else plan.frame
    return frame, plan.audit()


# ---- missing-value plan ----------------------------------------------------------------------------

def last_per_column(plan: list[MissingChoice]) -> list[MissingChoice]:
    """A later choice replaces an earlier one for the same column and moves to the end."""
    kept: dict[str, MissingChoice] = {}
    for choice in plan:
        if choice.column:
            kept.pop(choice.column, None)
            kept[choice.column] = choice
    return list(kept.values())


def missing_steps(plan: list[MissingChoice]) -> list[Step]:
    steps = []
    for c in last_per_column(plan):
        if c.method == "drop_column":
            steps.append(Step("drop_columns", columns=(c.column,)))
        elif c.method == "drop_rows":
            steps.append(Step("drop_missing_rows", columns=(c.column,)))
        elif c.method in FILL_METHODS:
            steps.append(Step("fill", column=c.column, method=c.method, value=c.fill_value))
    return steps


def _missing_total(df: DataFrame) -> Column:
    each = [P.comparable(df, c).isNull().cast("bigint") for c in P.data_columns(df)]
    return F.coalesce(F.sum(sum(each, F.lit(0))), F.lit(0))


def missing_effect(df: DataFrame, plan: list[MissingChoice]) -> DataFrame:
    """metric, before, after: missing_values, rows, columns."""
    after = apply_plan(df, missing_steps(plan))

    def sheet(frame: DataFrame, label: str) -> DataFrame:
        one = frame.agg(_missing_total(frame).alias("m"), F.count(F.lit(1)).alias("r"))
        width = F.lit(len(P.data_columns(frame))).cast("bigint")
        return C.to_rows(one, [{"metric": F.lit("missing_values"), label: F.col("m")},
                               {"metric": F.lit("rows"), label: F.col("r")},
                               {"metric": F.lit("columns"), label: width}])

    return sheet(df, "before").join(F.broadcast(sheet(after, "after")), "metric")  # three rows a side


def missing_impact(df: DataFrame, plan: list[MissingChoice]) -> DataFrame:
    """column, method, effect, expected: what each choice will touch (reads the profile only)."""
    plan = last_per_column(plan)
    effect = {"drop_column": "columns_removed", "drop_rows": "rows_removed"}
    rows = [(i, c.column, c.method,
             effect.get(c.method, "values_filled" if c.method in FILL_METHODS else "no_change"))
            for i, c in enumerate(plan)]
    chosen = df.sparkSession.createDataFrame(rows, "position int, column string, method string, effect string")
    counts = P.column_profile(df, distinct="none").select("column", P.missing_count().alias("missing"))
    expected = F.when(F.col("effect") == "columns_removed", F.lit(1).cast("bigint")).when(
        F.col("effect") == "no_change", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(F.col("missing"), F.lit(0).cast("bigint")))
    return chosen.join(F.broadcast(counts), "column", "left").select(  # one row per column
        "position", "column", "method", "effect", expected.alias("expected"))


# ---- duplicate plan --------------------------------------------------------------------------------

def duplicate_steps(plan: DuplicateChoice) -> list[Step]:
    if plan.method == "drop_all":
        return [Step("drop_duplicates")]
    if plan.method == "drop_selected" and plan.row_ids:
        return [Step("drop_rows", row_ids=tuple(dict.fromkeys(plan.row_ids)), key=plan.key)]
    return []


def _copies(df: DataFrame, key: str | None) -> DataFrame:
    """rows, extra rows and rows in groups, in one row; the row key is not part of a row's content."""
    content = df.drop(key) if key and key in df.columns else df
    return copy_groups(content).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("grouped"))


def duplicate_effect(df: DataFrame, plan: DuplicateChoice) -> DataFrame:
    """One row: rows before/after/removed, extra rows and group rows before and after."""
    after = apply_plan(df, duplicate_steps(plan))
    b, a = _copies(df, plan.key), _copies(after, plan.key)
    both = b.withColumn("a", a.select(F.struct("rows", "extra", "grouped")).scalar())
    return both.select(
        F.col("rows").alias("before_rows"), F.col("a.rows").alias("after_rows"),
        (F.col("rows") - F.col("a.rows")).alias("removed_rows"),
        F.col("extra").alias("before_extra"), F.col("a.extra").alias("after_extra"),
        F.col("grouped").alias("before_group_rows"), F.col("a.grouped").alias("after_group_rows"))


def rows_left_of_groups(df: DataFrame, plan: DuplicateChoice) -> DataFrame:
    """Rows of the original duplicate groups that remain after the plan.

    The match runs on distinct contents (copies already collapsed), so the right side has one row per group;
    a hot group on the left is split by adaptive skew-join handling.
    """
    content = [c for c in P.data_columns(df) if c != plan.key]
    groups = copy_groups(df.select(*content)).filter("copies > 1").drop("copies")
    left = apply_plan(df, duplicate_steps(plan))
    match = F.lit(True)
    renamed = groups.select(*[C.quoted(c).alias(f"_g_{c}") for c in content])
    for c in content:
        match = match & P.comparable(left, c).eqNullSafe(C.quoted(f"_g_{c}"))
    return left.join(renamed, match, "left_semi")


# ---- run and write ---------------------------------------------------------------------------------

AUDIT_GROUP = {"fill": "missing", "drop_missing_rows": "missing", "drop_columns": "missing",
               "drop_high_missing": "missing", "drop_duplicates": "duplicate", "drop_rows": "duplicate",
               "outlier": "outlier"}


def clean_dataset(df: DataFrame, steps: list[Step], path: str) -> DataFrame:
    """Write <path>/data and <path>/audit as Parquet and return the audit with its action group; one job writes and counts."""
    plan = ObservedPlan(df, steps)
    plan.run(lambda: plan.frame.write.mode("overwrite").parquet(f"{path}/data"))
    audit = plan.audit()
    groups = F.create_map(*[F.lit(x) for kv in AUDIT_GROUP.items() for x in kv])
    grouped = audit.withColumn("action_group", groups[F.col("kind")])
    grouped.coalesce(1).write.mode("overwrite").parquet(f"{path}/audit")
    return df.sparkSession.read.parquet(f"{path}/audit")
