"""Nested event properties as VARIANT: which paths occur with which kinds of value, and typed values of given paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C

LEVELS = 8
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"}  # all others are numbers


def kind_of(value: Column) -> Column:
    """object, array, text, number, boolean or null, for a VARIANT."""
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(named, name), F.lit("number"))


def property_paths(df: DataFrame, properties: str = "properties", levels: int = LEVELS) -> DataFrame:
    """path, kind, values: how often each path holds each kind of value, down to ``levels`` below the root.

    A path is ``$.key.key``, elements of a list are ``[*]``. Text that is no JSON and missing properties count nowhere; a JSON null
    counts as null. Each level is a narrow step on the rows of the one before, so the text is scanned and parsed once, and only
    (path, kind) counts are shuffled.
    """
    nodes = df.select(F.lit("$").alias("path"), F.try_parse_json(C.quoted(properties)).alias("value"), F.lit(True).alias("last"))
    for _ in range(levels):
        holds = F.col("last") & kind_of(F.col("value")).isin("object", "array")
        # a node stays, and one that holds others is there a second time to be taken apart
        copies = nodes.select("path", "value", F.explode(F.when(holds, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("opened"))
        inner = F.when(F.col("opened"), F.col("value")).alias("inner_value")
        nodes = df.sparkSession.sql(
            """SELECT CASE WHEN NOT opened THEN path WHEN inside.key IS NULL THEN path || '[*]' ELSE path || '.' || inside.key END AS path,
 CASE WHEN opened THEN inside.value ELSE outer_value END AS value, opened AS last
 FROM {copies}, LATERAL variant_explode_outer(inner_value) AS inside WHERE NOT opened OR inside.pos IS NOT NULL""",
            copies=copies.select("path", F.col("value").alias("outer_value"), "opened", inner))
    nodes = nodes.filter(F.col("value").isNotNull())  # here, not ahead of the steps, where it would be pushed down and parse the text twice
    return nodes.groupBy("path", kind_of(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("values"))


def property_columns(df: DataFrame, wanted: dict[str, tuple[str, str]], properties: str = "properties") -> DataFrame:
    """Adds a column for each name -> (path, type). NULL where the text is no JSON, the path is missing or its value does not fit the type."""
    parsed = F.try_parse_json(C.quoted(properties))
    return df.withColumns({name: F.try_variant_get(parsed, path, kind) for name, (path, kind) in wanted.items()})


def property_groups(df: DataFrame, by: str, of: str, properties: str = "properties") -> DataFrame:
    """value, events, measured, total, largest: events by the text at path ``by``, with sum and maximum of the number at path ``of``."""
    read = property_columns(df.select(C.quoted(properties)), {"_by": (by, "string"), "_of": (of, "double")}, properties)
    return read.groupBy(F.col("_by").alias("value")).agg(
        F.count(F.lit(1)).alias("events"), F.count("_of").alias("measured"), F.sum("_of").alias("total"), F.max("_of").alias("largest"))
