"""Column type tests and value access with pandas-like missing rules, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INF = float("inf")
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    """Bool never counts as numeric here."""
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_bool(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def family_of(dtype: T.DataType) -> str:
    if is_datetime(dtype):
        return "datetime"
    return "numeric" if is_numeric(dtype) or is_bool(dtype) else "text"


def columns_where(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c in columns_where(df, is_numeric) if c not in set(exclude)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL.

    ``nanvl`` names the column once; a CASE would name it twice, and stacked over derived columns that doubles
    the expression at every level once Catalyst inlines the projections.
    """
    dtype = dtype_of(df, name)
    return F.nanvl(quoted(name), F.lit(None).cast(dtype)) if is_float(dtype) else quoted(name)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float column, once at ingest."""
    floats = columns_where(df, is_float)
    return df.withColumns({c: present(df, c) for c in floats}) if floats else df


def text_to_double(col: Column) -> Column:
    """Text to double; anything that is not a plain decimal or infinity gives NULL."""
    good = col.rlike(NUMBER_PATTERN) | col.rlike(INFINITY_PATTERN)
    return F.when(good, F.trim(col).try_cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    """Coerce one column to a number: bad text, dates and nested values give NULL."""
    dtype = dtype_of(df, name)
    if is_numeric(dtype):
        return present(df, name)
    if is_bool(dtype):
        return quoted(name).cast("int")
    if is_text(dtype):
        return text_to_double(quoted(name))
    return F.lit(None).cast("double")


def as_double(df: DataFrame, name: str) -> Column:
    return as_number(df, name).cast("double")


def as_finite(df: DataFrame, name: str) -> Column:
    number = as_double(df, name)
    return F.when(F.abs(number) < INF, number)


def row_struct(df: DataFrame, exclude=()) -> Column:
    return F.struct(*[quoted(c) for c in df.columns if c not in set(exclude)])


def any_missing(df: DataFrame, columns=None) -> Column:
    test = F.lit(False)
    for c in columns or df.columns:
        test = test | present(df, c).isNull()
    return test


def to_rows(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry (no scan, no shuffle)."""
    structs = [F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


def percent(part: Column, whole: Column) -> Column:
    """part / max(whole, 1) * 100, unrounded."""
    return part / F.greatest(whole, F.lit(1)) * F.lit(100.0)
