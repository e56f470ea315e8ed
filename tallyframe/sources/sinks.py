"""Writers: CSV with a byte-order mark, Parquet datasets, the redacted event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators.profiling import exportable_cells

# A property whose key contains one of these is never written.
PRIVATE_KEY_WORDS = ("phone", "mobile", "email", "customer_name")
REDACTED = "[redacted]"
BOM = "﻿"


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Part files with a header each; the first header starts with a UTF-8 byte-order mark for spreadsheets."""
    flat = exportable_cells(df)
    if bom and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], BOM + flat.columns[0])
    flat.write.mode("overwrite").options(header=True, encoding="UTF-8").csv(path)


def write_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


NESTED_LEVELS = 8


def redact(properties: Column, depth: int = NESTED_LEVELS) -> Column:
    """JSON object text with private values replaced, other value types kept.

    Nested objects are cleaned value by value down to ``depth`` levels; an object below that is replaced as a whole if a
    private key occurs anywhere in its text. Lists that hold objects or lists are left out.
    """
    private = F.lit("(?i)(" + "|".join(PRIVATE_KEY_WORDS) + ")")
    members = lambda value: F.try_variant_get(value, "$", "map<string,variant>")  # noqa: E731  null unless an object
    items = lambda value: F.try_variant_get(value, "$", "array<variant>")  # noqa: E731  null unless a list

    def clean(levels: int, top: bool = False):
        def value_of(key: Column, value: Column) -> Column:
            deep_list = F.exists(items(value), lambda v: F.to_json(v).rlike(r"^[\[{]"))
            out = F.when(F.regexp_like(key, private), _json(REDACTED)).when(deep_list, _json("[omitted list]"))
            if levels > 1:
                # the text is taken once a row: numbers within objects are those that their own text holds
                inner = members(F.parse_json(F.to_json(members(value))) if top else value)
                return out.otherwise(F.coalesce(F.to_variant_object(F.transform_values(inner, clean(levels - 1))), value))
            return out.when(members(value).isNotNull() & F.regexp_like(F.to_json(value), private), _json(REDACTED)).otherwise(value)

        return value_of

    return F.to_json(F.transform_values(F.from_json(properties, "map<string,variant>"), clean(depth, top=True)))


def _json(text: str) -> Column:
    return F.parse_json(F.lit(f'"{text}"'))


def write_events(df: DataFrame, path: str, properties: str = "properties") -> None:
    """Append events as JSON Lines with private properties redacted.

    Rows are dealt evenly first: redaction is work by the row, and a small file holds many rows in one split.
    """
    out = df.hint("rebalance").withColumn(properties, redact(F.col(properties))) if properties in df.columns else df
    out.write.mode("append").json(path)
