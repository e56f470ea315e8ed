"""Build one analysis dataset by left joins in stored order, with an audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.functions.names import table_suffix
from tallyframe.operators.joins import Relationship, left_join

AUDIT_SCHEMA = ("position int, left_field string, right_table string, right_field string, applied boolean, reason string, "
                "rows_before bigint, rows_after bigint, row_expansion double, nulls_before bigint, nulls_after bigint, "
                "warnings string")


@dataclass(frozen=True)
class Hop:
    """One relationship turned into a join of the growing dataset with a table, or the reason it is skipped."""

    left_field: str
    table: str
    right_field: str
    reason: str | None = None


def plan_hops(base: str, tables: dict[str, DataFrame], relationships: list[Relationship]) -> list[Hop]:
    """Walk the relationships in order, in whichever direction reaches a new table (schemas only).

    A key is the field of its own table, under the name it got in the dataset, and never another table's field of that name.
    """
    inside, hops = {base}, []
    named = {(base, c): c for c in tables[base].columns}  # (table, field) -> column of the dataset
    for rel in relationships:
        if rel.table_a not in tables or rel.table_b not in tables:
            hops.append(Hop(rel.field_a, rel.table_b, rel.field_b, "table_missing"))
            continue
        key_a, key_b = named.get((rel.table_a, rel.field_a)), named.get((rel.table_b, rel.field_b))
        if key_a and rel.table_b not in inside:
            hop = Hop(key_a, rel.table_b, rel.field_b)
        elif key_b and rel.table_a not in inside:
            hop = Hop(key_b, rel.table_a, rel.field_a)
        elif {rel.table_a, rel.table_b} <= inside:
            hops.append(Hop(rel.field_a, rel.table_b, rel.field_b, "both_sides_joined"))
            continue
        else:
            hops.append(Hop(rel.field_a, rel.table_b, rel.field_b, "key_not_in_dataset"))
            continue
        if hop.right_field not in tables[hop.table].columns:
            hops.append(Hop(hop.left_field, hop.table, hop.right_field, "right_key_missing"))
            continue
        hops.append(hop)
        inside.add(hop.table)
        taken, suffix = set(named.values()), f"__{table_suffix(hop.table)}"
        for c in tables[hop.table].columns:
            same = c == hop.right_field == hop.left_field  # one key column is left of two with one name
            named[hop.table, c] = c if same or c not in taken else c + suffix
    return hops


def joined_dataset(base: str, tables: dict[str, DataFrame], relationships: list[Relationship]) -> DataFrame:
    """The dataset as one lazy plan."""
    df = tables[base]
    for hop in plan_hops(base, tables, relationships):
        if hop.reason is None:
            df = left_join(df, tables[hop.table], hop.left_field, hop.right_field, hop.table)
    return df


def _size(df: DataFrame) -> tuple[int, int]:
    nulls = sum((F.count_if(C.quoted(c).isNull()) for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)), nulls.cast("bigint")).first()
    return row[0], row[1]


def build_analysis_dataset(base: str, tables: dict[str, DataFrame], relationships: list[Relationship],
                           path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(dataset, audit). With a path the dataset is written as Parquet and read back."""
    if not relationships:
        raise ValueError("no relationship given")
    df, audit = tables[base], []
    rows, nulls = _size(df)
    for i, hop in enumerate(plan_hops(base, tables, relationships)):
        if hop.reason:
            audit.append((i, hop.left_field, hop.table, hop.right_field, False, hop.reason, *[None] * 5, "join_not_applied"))
            continue
        df = left_join(df, tables[hop.table], hop.left_field, hop.right_field, hop.table)
        after_rows, after_nulls = _size(df)
        growth = after_rows / rows if rows else 0.0
        notes = ["expansion_over_2"] if growth > 2 else (["expansion_over_1_2"] if growth > 1.2 else [])
        if after_nulls > nulls * 1.5 and after_nulls - nulls > max(10, after_rows * 0.1):
            notes.append("missing_values_jump")
        audit.append((i, hop.left_field, hop.table, hop.right_field, True, None, rows, after_rows, round(growth, 4), nulls,
                      after_nulls, ";".join(notes)))
        rows, nulls = after_rows, after_nulls
    spark = df.sparkSession
    if path:
        df.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df, spark.createDataFrame(audit, AUDIT_SCHEMA)
