"""What a column is: coarse types, identifier rules, business field types, exploration roles.

Everything reads the one-pass column profile; a result has one row per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C, names as N
from tallyframe.functions.parsing import parse_datetime
from tallyframe.operators import profiling as P

ROLES = ("identifier", "numeric", "categorical", "boolean", "datetime", "derived_time", "constant", "unsupported")
FIELD_TYPES = ("date", "amount", "quantity", "id", "product", "region", "person", "category", "other", "ignore")
ROLE_OF_FIELD_TYPE = {
    "date": "datetime", "amount": "numeric", "quantity": "numeric", "id": "identifier", "product": "categorical",
    "region": "categorical", "person": "categorical", "category": "categorical", "other": "unsupported",
    "ignore": "unsupported",
}


def _flag(columns: list[str], test) -> Column:
    hits = [c for c in columns if test(c)]
    return F.col("column").isin(hits) if hits else F.lit(False)


def parse_share() -> Column:
    """Share of non-null values that read as a date; 0 for an empty column."""
    return F.coalesce(F.try_divide(F.col("parsed"), F.col("non_null")), F.lit(0.0))


def detect_types(df: DataFrame) -> DataFrame:
    """column, dtype, detected: numeric | datetime | categorical | text | other."""
    cols = P.data_columns(df)
    dates = C.columns_where(df, C.is_datetime)
    texts, bools = C.columns_where(df, C.is_text), C.columns_where(df, C.is_bool)
    prof = P.column_profile(df, dates=texts)
    numbers = C.columns_where(df, C.is_numeric)
    hinted = _flag(cols, lambda c: N.has_hint(c, N.DETECT_DATE_NAME_HINTS))
    few = (F.col("distinct_count") <= 50) | (C.percent(F.col("distinct_count"), F.col("non_null")) <= 20)
    is_text, is_bool = F.col("column").isin(texts), F.col("column").isin(bools)
    kind = (
        F.when(F.col("column").isin(dates), "datetime")
        .when(is_text & (hinted | (F.col("distinct_count") > 5)) & (parse_share() >= 0.8), "datetime")
        .when(F.col("column").isin(numbers), "numeric")
        .when((is_text | is_bool) & few, "categorical")
        .when(is_text | is_bool, "text")
        .otherwise("other")
    )
    return prof.select("column", "dtype", kind.alias("detected"))


def apply_detected_types(df: DataFrame, detected: DataFrame) -> DataFrame:
    """Replace text columns detected as datetime by parsed timestamps (reads one row per column)."""
    found = {r["column"] for r in detected.filter("detected = 'datetime'").select("column").collect()}
    texts = [c for c in C.columns_where(df, C.is_text) if c in found]
    return df.withColumns({c: parse_datetime(df, c) for c in texts}) if texts else df


def date_like_columns(df: DataFrame, confirmed: dict[str, str] | None = None) -> DataFrame:
    """column, source: confirmed | dtype | values (name hint and at least 80 % of non-null values parse)."""
    confirmed = confirmed or {}
    cols = P.data_columns(df)
    prof = P.column_profile(df, distinct="none", dates=[c for c in cols if N.has_hint(c, N.DATE_NAME_HINTS)])
    source = (
        F.when(_flag(cols, lambda c: confirmed.get(c) == "date"), "confirmed")
        .when(F.col("family") == "datetime", "dtype")
        .when(_flag(cols, lambda c: N.has_hint(c, N.DATE_NAME_HINTS)) & (parse_share() >= 0.8), "values")
    )
    return prof.select("column", source.alias("source")).filter("source IS NOT NULL")


def infer_field_mapping(df: DataFrame, confirmed: dict[str, str] | None = None,
                        profile: DataFrame | None = None) -> DataFrame:
    """column, dtype, inferred_type, confidence, reason, confirmed_type; the first rule that fits wins."""
    confirmed = {c: t for c, t in (confirmed or {}).items() if t in FIELD_TYPES}
    cols = P.data_columns(df)
    prof = P.column_profile(df) if profile is None else profile
    texts = [c for c in C.columns_where(df, C.is_text) if c in cols and not N.has_hint(c, N.MAP_DATE_HINTS)]
    prof = prof.join(F.broadcast(_date_share(df, texts)), "column", "left")  # one row per column

    numeric = F.col("family") == "numeric"
    plain_number = _flag(cols, lambda c: C.is_numeric(C.dtype_of(df, c)))
    ratio = P.unique_ratio()
    textual = _flag(cols, lambda c: C.is_text(C.dtype_of(df, c)) or C.is_bool(C.dtype_of(df, c)))
    low = F.col("distinct_count") <= F.least(
        F.lit(20), F.greatest(F.lit(5), F.floor(F.col("non_null") * F.lit(0.1)).cast("bigint")))

    def hint(words) -> Column:
        return _flag(cols, lambda c: N.has_hint(c, words))

    rules = [
        (F.col("family") == "datetime", "date", 0.99, "datetime_dtype"),
        (hint(N.MAP_DATE_HINTS), "date", 0.95, "date_name"),
        (F.coalesce(F.col("share"), F.lit(0.0)) >= 0.8, "date", 0.85, "values_parse_as_date"),
        (numeric & hint(N.MAP_AMOUNT_HINTS), "amount", 0.95, "amount_name"),
        (numeric & hint(N.MAP_QUANTITY_HINTS), "quantity", 0.95, "quantity_name"),
        (hint(N.MAP_ID_HINTS), "id", 0.97, "id_name"),
        (hint(N.MAP_REGION_HINTS), "region", 0.95, "region_name"),
        (hint(N.MAP_PRODUCT_HINTS), "product", 0.93, "product_name"),
        (hint(N.MAP_PERSON_HINTS), "person", 0.92, "person_name"),
        ((ratio > 0.8) & (~plain_number | F.coalesce(F.col("whole"), F.lit(False))), "id", 0.82, "unique_values"),
        (textual | ((F.col("non_null") > 0) & low), "category", 0.75, "low_cardinality"),
    ]
    chosen = reduce(
        lambda chain, r: chain.when(r[0], F.struct(F.lit(r[1]).alias("t"), F.lit(r[2]).alias("c"), F.lit(r[3]).alias("r"))),
        rules, F).otherwise(F.struct(F.lit("other").alias("t"), F.lit(0.55).alias("c"), F.lit("no_rule").alias("r")))
    kept = F.lit(None).cast("string")
    if confirmed:
        kept = F.create_map(*[F.lit(x) for pair in confirmed.items() for x in pair])[F.col("column")]
    return prof.withColumn("_p", chosen).select(
        "column", "dtype", F.col("_p.t").alias("inferred_type"), F.col("_p.c").alias("confidence"),
        F.col("_p.r").alias("reason"), F.coalesce(kept, F.col("_p.t")).alias("confirmed_type"))


def _date_share(df: DataFrame, texts: list[str]) -> DataFrame:
    """column, share of all non-null values that parse; one pass without a shuffle of values."""
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, share double")
    return P.column_profile(df.select(*[C.quoted(c) for c in texts]), distinct="none", dates=texts).select("column", parse_share().alias("share"))


# ---- identifiers ---------------------------------------------------------------------------------

def identifier_strict(df: DataFrame) -> DataFrame:
    """column, reason (name | unique) for columns that identify records; dates never do."""
    cols = P.data_columns(df)
    prof = P.column_profile(df)
    by_name = _flag(cols, N.is_strict_id_name)
    measure = _flag(cols, lambda c: N.has_hint(c, N.STRICT_MEASURE_HINTS))
    ratio = F.try_divide(F.col("distinct_count"), F.col("non_null"))
    number = _flag(cols, lambda c: C.is_numeric(C.dtype_of(df, c)))
    unique = (ratio > 0.9) & (F.try_divide(P.missing_count(), F.col("total")) < 0.5) & ~measure & (
        ~number | F.coalesce(F.col("whole"), F.lit(False)))
    reason = F.when(by_name, "name").when(unique, "unique")
    return _identifier_rows(prof.filter((F.col("family") != "datetime") & (F.col("non_null") > 0)), reason)


def identifier_wide(df: DataFrame, manual_ids=(), manual_non_ids=()) -> DataFrame:
    """Any id substring or nearly unique values; (automatic + manual) - manual exclusions."""
    cols = P.data_columns(df)
    prof = P.column_profile(df, dates=[c for c in cols if N.has_hint(c, N.DATE_NAME_HINTS)])
    by_name = _flag(cols, lambda c: N.has_hint(c, N.WIDE_ID_HINTS))
    measure = _flag(cols, lambda c: N.has_hint(c, N.WIDE_MEASURE_HINTS))
    date_like = (F.col("family") == "datetime") | (
        _flag(cols, lambda c: N.has_hint(c, N.DATE_NAME_HINTS)) & (parse_share() >= 0.8))
    usable = ~date_like & (F.col("non_null") > 0)
    forced_out = _flag(cols, lambda c: c in set(manual_non_ids))
    forced_in = _flag(cols, lambda c: c in set(manual_ids))
    reason = (
        F.when(forced_out, None)
        .when(usable & by_name, "name")
        .when(usable & (P.unique_ratio() > 0.9) & ~measure, "unique")
        .when(forced_in, "manual")
    )
    return _identifier_rows(prof, reason)


def _identifier_rows(prof: DataFrame, reason: Column) -> DataFrame:
    return prof.select("column", "dtype", "non_null", "distinct_count", reason.alias("reason")).filter(
        "reason IS NOT NULL")


def identifier_names(found: DataFrame) -> list[str]:
    """Names out of a one-row-per-column result."""
    return [r["column"] for r in found.select("column").collect()]


def identifier_summary(found: DataFrame) -> DataFrame:
    return found.select("column", "dtype", "distinct_count",
                        C.percent(F.col("distinct_count"), F.col("non_null")).alias("unique_pct"), "reason")


def invalid_columns(df: DataFrame, missing_threshold: float = 0.95) -> DataFrame:
    """column, missing_pct, reason: unnamed, or nearly empty."""
    cols = P.data_columns(df)
    prof = P.column_profile(df, distinct="none")
    empty = F.try_divide(P.missing_count(), F.col("total")) >= missing_threshold
    reason = F.when(_flag(cols, N.is_unnamed), "unnamed").when(empty, "mostly_missing")
    return prof.select("column", P.missing_percent().alias("missing_pct"), reason.alias("reason")).filter(
        "reason IS NOT NULL")


# ---- exploration roles ---------------------------------------------------------------------------

# How a year, month, quarter or weekday may be written.
TIME_PART_TEXT = {
    "year": None,
    "month": r"(?i)^(0?[1-9]|1[0-2])月$",
    "quarter": r"(?i)^((\d{4})\s*[-/]?\s*)?(Q[1-4]|第?[1-4]季度)$",
    "weekday": r"(?i)^(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Mon|Tue|Wed|Thu|Fri|Sat|Sun"
               r"|星期[一二三四五六日天]|周[一二三四五六日天])$",
}
TIME_PART_RANGE = {"year": (1000, 9999), "month": (1, 12), "quarter": (1, 4), "weekday": (0, 7)}


def time_part_match(df: DataFrame, column: str, part: str) -> Column:
    """Does this value look like the named date part?"""
    value = C.present(df, column)
    text = F.trim(value.cast("string"))
    number = C.text_to_double(text)
    low, high = TIME_PART_RANGE[part]
    hit = (F.abs(number - F.rint(number)) <= 1e-9) & number.between(low, high)
    hit = F.coalesce(hit, F.lit(False))
    if TIME_PART_TEXT[part]:
        hit = hit | text.rlike(TIME_PART_TEXT[part])
    return F.when(value.isNotNull(), hit)


def derived_time_columns(df: DataFrame) -> DataFrame:
    """column, part, match_ratio, is_derived_time for columns named like a date part."""
    named = {c: N.time_part_of(c) for c in P.data_columns(df)}
    named = {c: p for c, p in named.items() if p and not C.is_datetime(C.dtype_of(df, c))}
    if not named:
        return df.sparkSession.createDataFrame(
            [], "column string, part string, match_ratio double, is_derived_time boolean")
    one = df.agg(*[F.avg(time_part_match(df, c, p).cast("int")).alias(f"m{i}")
                   for i, (c, p) in enumerate(named.items())])
    rows = C.to_rows(one, [{"column": F.lit(c), "part": F.lit(p), "match_ratio": F.col(f"m{i}")}
                           for i, (c, p) in enumerate(named.items())])
    return rows.withColumn("is_derived_time", F.coalesce(F.col("match_ratio") >= 0.8, F.lit(False)))


def field_roles(df: DataFrame, identifiers=(), datetimes=(), invalid=(),
                confirmed: dict[str, str] | None = None) -> DataFrame:
    """One role per column with the reason it is left out, and two flags about time columns."""
    cols = P.data_columns(df)
    confirmed = {c: ROLE_OF_FIELD_TYPE.get(t, t) for c, t in (confirmed or {}).items()}
    confirmed = {c: r for c, r in confirmed.items() if r in ROLES}
    prof = P.column_profile(df).join(
        F.broadcast(derived_time_columns(df).select("column", "is_derived_time")), "column", "left")  # per column
    derived = F.coalesce(F.col("is_derived_time"), F.lit(False))
    given = F.lit(None).cast("string")
    if confirmed:
        given = F.create_map(*[F.lit(x) for pair in confirmed.items() for x in pair])[F.col("column")]

    def typed(test) -> Column:
        return _flag(cols, lambda c: test(C.dtype_of(df, c)))

    bad = _flag(cols, lambda c: c in set(invalid))
    role = (
        F.when(bad, "unsupported")
        .when((given == "datetime") & derived, "derived_time")
        .when(given.isNotNull(), given)
        .when(_flag(cols, lambda c: c in set(identifiers)), "identifier")
        .when(derived, "derived_time")
        .when(_flag(cols, lambda c: c in set(datetimes)) | typed(C.is_datetime), "datetime")
        .when(F.col("distinct_count") == 1, "constant")
        .when(typed(C.is_bool), "boolean")
        .when(typed(C.is_numeric), "numeric")
        .when(typed(C.is_text) & (F.col("non_null") > 0), "categorical")
        .otherwise("unsupported")
    )
    reason = (
        F.when(F.col("role") == "identifier", "identifier")
        .when(F.col("role") == "datetime", "datetime")
        .when(F.col("role") == "derived_time", "derived_time")
        .when(F.col("role") == "constant", "single_value")
        .when(bad, "invalid_column")
        .when((F.col("role") == "unsupported") & given.isNotNull(), "excluded_by_user")
        .when((F.col("role") == "unsupported") & (F.col("non_null") == 0) & typed(C.is_text), "all_missing")
        .when(F.col("role") == "unsupported", "unsupported_type")
    )
    return prof.withColumn("role", role).select(
        "position", "column", "dtype", "role", reason.alias("reason"),
        ((F.coalesce(given, F.lit("")) == "datetime") & derived).alias("date_confirmed_but_partial"),
        ((F.col("role") == "datetime") & ~derived & ~typed(lambda t: C.is_numeric(t) or C.is_bool(t))).alias("time_usable"),
    )


def exploration_overview(df: DataFrame, roles: DataFrame) -> DataFrame:
    """item, value (text), reason: counts per role, the single date column's range, excluded fields."""
    roles = P.pinned(roles)
    dates = [r["column"] for r in roles.filter("role = 'datetime'").orderBy("position").collect()]
    single = dates[0] if len(dates) == 1 else None
    parsed = parse_datetime(df, single) if single else F.lit(None).cast("timestamp_ntz")
    table = df.agg(F.count(F.lit(1)).alias("rows"), F.min(parsed).alias("a"), F.max(parsed).alias("b"))
    mode = "single" if single else ("multiple" if dates else "none")
    none = F.lit(None).cast("string")
    base = C.to_rows(table, [
        {"item": F.lit("row_count"), "value": F.col("rows").cast("string"), "reason": none},
        {"item": F.lit("column_count"), "value": F.lit(str(len(P.data_columns(df)))), "reason": none},
        {"item": F.lit("date_mode"), "value": F.lit(mode), "reason": none},
        {"item": F.lit("start_date"), "value": F.date_format("a", "yyyy-MM-dd"), "reason": none},
        {"item": F.lit("end_date"), "value": F.date_format("b", "yyyy-MM-dd"), "reason": none},
    ])
    counts = C.to_rows(
        roles.agg(
            F.count_if(F.col("role") == "numeric").alias("numeric"),
            F.count_if(F.col("role").isin("categorical", "boolean")).alias("categorical"),
            F.count_if(F.col("role") == "datetime").alias("datetime"),
            F.count_if(F.col("role") == "identifier").alias("identifier")),
        [{"item": F.lit(f"{k}_count"), "value": F.col(k).cast("string"), "reason": none}
         for k in ("numeric", "categorical", "datetime", "identifier")])
    excluded = roles.filter(F.col("role").isin("identifier", "derived_time", "constant", "unsupported")).select(
        F.lit("excluded").alias("item"), F.col("column").alias("value"), "reason")
    return base.unionByName(counts).unionByName(excluded)


def analysis_columns(df: DataFrame, identifiers=()) -> DataFrame:
    """column, kind for columns that take part in analysis.

    numeric: not an identifier. categorical: text or bool with few values. measure: numeric with a name
    that is not id-like (phone, code, ...), the ones used for outlier work.
    """
    cols = [c for c in P.data_columns(df) if c not in set(identifiers)]
    numbers = [c for c in cols if C.is_numeric(C.dtype_of(df, c))]
    labels = [c for c in cols if C.is_text(C.dtype_of(df, c)) or C.is_bool(C.dtype_of(df, c))]
    measures = [c for c in numbers if not N.has_hint(c, N.IQR_ID_HINTS)]
    few = (F.col("distinct_count") <= 50) | (C.percent(F.col("distinct_count"), F.col("non_null")) <= 20)
    known = df.sparkSession.createDataFrame(
        [(c, "numeric") for c in numbers] + [(c, "measure") for c in measures], "column string, kind string")
    if not labels:
        return known
    return known.unionByName(
        P.column_profile(df, labels).filter(few).select("column", F.lit("categorical").alias("kind")))


def measure_columns(df: DataFrame, identifiers=()) -> list[str]:
    """Numeric columns whose name is not id-like and that are not identifiers (schema only)."""
    return [c for c in C.numeric_columns(df, set(identifiers) | {P.ROW_ID}) if not N.has_hint(c, N.IQR_ID_HINTS)]
