"""Mixed-format dates and identifier text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.columns import dtype_of, is_datetime, is_float, is_numeric, is_text, quoted

# Ordered: the first format that fits wins.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/M/d HH:mm:ss",
    "yyyy/M/d HH:mm",
    "yyyy/M/d",
    "yyyy.M.d",
    "yyyyMMdd",
    "yyyy年M月d日",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
)


def parse_datetime_text(col: Column, formats=DATETIME_FORMATS) -> Column:
    text = F.trim(col)
    # Local wall time is kept, an offset is dropped.
    wall = F.regexp_replace(text, r"(?<=\d{2}:\d{2}:\d{2})(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})$", "$1")
    iso = F.when(wall.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"), wall.try_cast("timestamp_ntz"))
    # The shape test keeps texts that cannot fit away from the (slow to fail) parser.
    parsed = [F.when(text.rlike(shape_of(f)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for f in formats]
    return F.coalesce(iso, *parsed)


def shape_of(fmt: str) -> str:
    """Regular expression for the texts a datetime format can read."""
    widths = {"yyyy": r"\d{4}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}",
              "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}
    tokens = re.findall(r"yyyy|MMM|MM|M|dd|d|HH|mm|ss|'[^']*'|.", fmt)
    return "^" + "".join(widths.get(t) or re.escape(t.strip("'")) for t in tokens) + "$"


def parse_datetime(df: DataFrame, name: str, formats=DATETIME_FORMATS) -> Column:
    """Dates stay, numbers are never epochs (NULL), text is tried format by format."""
    dtype = dtype_of(df, name)
    if is_datetime(dtype):
        return quoted(name).cast("timestamp_ntz")
    if is_text(dtype):
        return parse_datetime_text(quoted(name), formats)
    return F.lit(None).cast("timestamp_ntz")


def id_text(df: DataFrame, name: str) -> Column:
    """Identifier as text: 12.0 -> '12', infinities and NULL -> ''."""
    dtype, col = dtype_of(df, name), quoted(name)
    if is_float(dtype):
        whole = F.format_string("%.0f", col)
        trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col), "0+$", ""), r"\.$", "")
        text = F.when(col.isNull() | F.isnan(col) | (F.abs(col) == float("inf")), F.lit(""))
        text = text.when(col == F.floor(col), whole).otherwise(trimmed)
    elif isinstance(dtype, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif is_numeric(dtype):
        text = col.cast("string")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))
