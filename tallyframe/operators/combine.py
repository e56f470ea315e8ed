"""Union of tables by field name, with a fill rule per missing field and an audit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.functions import columns as C
from tallyframe.operators import cleaning as K, profiling as P

STRATEGIES = ("blank", "zero", "unknown", "mode", "custom")


@dataclass(frozen=True)
class Fill:
    """How a field is filled in tables that lack it."""

    field: str
    strategy: str = "blank"
    custom_value: str = ""


def all_fields(tables: dict[str, DataFrame]) -> list[str]:
    return list(dict.fromkeys(c for df in tables.values() for c in df.columns))


def _common_type(field: str, tables: dict[str, DataFrame]) -> T.DataType:
    """Field type over the tables that have it: equal types stay, numbers widen, anything else is text."""
    types = [C.dtype_of(df, field) for df in tables.values() if field in df.columns]
    if all(t == types[0] for t in types):
        return types[0]
    if all(C.is_numeric(t) for t in types):
        whole = all(isinstance(t, T.IntegralType) for t in types)
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


def append_tables(tables: dict[str, DataFrame], fills: list[Fill] = ()) -> DataFrame:
    """UNION ALL by name; no shuffle, apart from the grouped mode of a field that asks for it."""
    if len(tables) < 2:
        raise ValueError("append needs at least two tables")
    fields = all_fields(tables)
    kinds = {f: _common_type(f, tables) for f in fields}
    rule = {f.field: f for f in fills}
    values = {f: _fill_value(f, rule.get(f, Fill(f)), tables, kinds) for f in fields
              if any(f not in df.columns for df in tables.values())}
    parts = []
    for df in tables.values():
        parts.append(df.select(*[
            (C.quoted(f).cast(kinds[f]) if f in df.columns else values[f].cast(kinds[f])).alias(f) for f in fields]))
    return reduce(DataFrame.unionByName, parts)


def _fill_value(field: str, fill: Fill, tables: dict[str, DataFrame], kinds: dict[str, T.DataType]):
    """The fill value as a column; a text fill in a non-text field turns the whole field to text."""
    if fill.strategy == "zero":
        return F.lit(0)
    if fill.strategy in ("unknown", "custom"):
        text = "未知" if fill.strategy == "unknown" else fill.custom_value
        if not C.is_text(kinds[field]):
            kinds[field] = T.StringType()
        return F.lit(text)
    if fill.strategy == "mode":
        having = [df.select(C.quoted(field).cast(kinds[field]).alias(field)) for df in tables.values() if field in df.columns]
        return K.mode_of(reduce(DataFrame.unionByName, having), field).scalar()
    return F.lit(None)


def schema_similarity(tables: dict[str, DataFrame]) -> float:
    """Mean pairwise Jaccard similarity of the column sets, 4 decimals (schema only)."""
    sets = [set(df.columns) for df in tables.values()]
    scores = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in combinations(sets, 2)]
    return round(sum(scores) / len(scores), 4) if scores else 1.0


def append_audit(tables: dict[str, DataFrame], appended: DataFrame) -> DataFrame:
    """One row per source: rows, its missing, own and common fields, schema facts, and the row-count check."""
    fields = all_fields(tables)
    common = [f for f in fields if all(f in df.columns for df in tables.values())]
    order_differs = len({tuple(df.columns) for df in tables.values()}) > 1
    similar = schema_similarity(tables)
    out = []
    for name, df in tables.items():
        missing = [f for f in fields if f not in df.columns]
        own = [f for f in df.columns if sum(f in t.columns for t in tables.values()) == 1]
        out.append(df.agg(
            F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
            F.lit(",".join(missing)).alias("missing_fields"), F.lit(",".join(own)).alias("only_here"),
            F.lit(",".join(common)).alias("common_fields"), F.lit(order_differs).alias("order_differs"),
            F.lit(similar).alias("schema_similarity")))
    sources = reduce(DataFrame.unionByName, out)
    total = appended.agg(F.count(F.lit(1))).scalar()
    expected = sources.agg(F.sum("rows")).scalar()
    return sources.withColumn("row_count_matches", expected == total)


def filled_fields(tables: dict[str, DataFrame], fills: list[Fill] = ()) -> DataFrame:
    """field, missing_in, field_type (of the first table having it), strategy."""
    rule, parts = {f.field: f for f in fills}, []
    schema = "field string, missing_in string, strategy string, field_type string"
    spark = next(iter(tables.values())).sparkSession
    for field in sorted(all_fields(tables)):
        absent = [n for n, df in tables.items() if field not in df.columns]
        if not absent:
            continue
        owner = next(df for df in tables.values() if field in df.columns)
        dtype = C.dtype_of(owner, field)
        strategy = rule.get(field, Fill(field)).strategy
        strategy = strategy if strategy in STRATEGIES else "blank"
        head = [F.lit(field).alias("field"), F.lit(",".join(absent)).alias("missing_in"), F.lit(strategy).alias("strategy")]
        if C.is_numeric(dtype) or C.is_bool(dtype) or C.is_datetime(dtype):
            kind = "date" if C.is_datetime(dtype) else "numeric"
            parts.append(spark.createDataFrame([(field, ",".join(absent), strategy, kind)], schema))
        else:
            ratio = F.coalesce(F.try_divide(F.count_distinct(P.comparable(owner, field)), F.count(F.lit(1))), F.lit(0.0))
            parts.append(owner.agg(*head, F.when(ratio <= 0.5, "category").otherwise("text").alias("field_type")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
