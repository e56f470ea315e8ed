"""KPI definitions compiled to aggregate columns: a whole board is one pass over the data."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C, names as N
from tallyframe.operators import profiling as P, roles as R

BASIC = ("sum", "count", "count_rows", "count_distinct", "avg", "max", "min")
INF = float("inf")
ID_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tallyframe:kpi-candidate")


@dataclass(frozen=True)
class Kpi:
    kpi_id: str
    name: str
    aggregation: str
    source_field: str = ""
    numerator_id: str = ""
    denominator_id: str = ""
    field_type: str = ""
    category: str = "core"
    enabled: bool = True
    valid: bool = True


def _status_of(df: DataFrame, kpi: Kpi) -> tuple[str, str]:
    """Status and message known from the definition and the schema alone."""
    if kpi.aggregation == "reserved":
        return "unsupported", "reserved"
    if kpi.aggregation == "ratio":
        return "unsupported", "use_ratio"
    if kpi.aggregation not in BASIC:
        return "invalid_definition", "unknown_aggregation"
    if kpi.aggregation == "count_rows":
        return "ok", "row_count"
    if not kpi.source_field:
        return "invalid_definition", "no_source_field"
    if kpi.source_field not in df.columns:
        return "missing_field", "missing_field"
    return "ok", "computed"


def _value(df: DataFrame, kpi: Kpi) -> tuple[Column | None, Column | None]:
    """(numeric, text) aggregate, None where there is none; max and min work on raw values, dates and text included."""
    if _status_of(df, kpi)[0] != "ok":
        return None, None
    if kpi.aggregation == "count_rows":
        return F.count(F.lit(1)).cast("double"), None
    value = C.present(df, kpi.source_field)
    if kpi.aggregation == "count":
        return F.count(value).cast("double"), None
    if kpi.aggregation == "count_distinct":
        return F.count_distinct(P.comparable(df, kpi.source_field)).cast("double"), None
    if kpi.aggregation in ("sum", "avg"):
        number = C.as_double(df, kpi.source_field)
        return (F.coalesce(F.sum(number), F.lit(0.0)) if kpi.aggregation == "sum" else F.avg(number)), None
    pick = F.max if kpi.aggregation == "max" else F.min
    if C.is_numeric(C.dtype_of(df, kpi.source_field)):
        return pick(value).cast("double"), None
    return None, pick(value).cast("string")


class _Pass:
    """Collects the aggregates of many KPIs into one agg call; the same aggregate is computed once."""

    def __init__(self, df: DataFrame):
        self.df, self.aggs, self.seen = df, [F.count(F.lit(1)).alias("rows")], {}

    def take(self, kpi: Kpi) -> tuple[Column, Column]:
        key = (kpi.aggregation, kpi.source_field)
        if key not in self.seen:
            i, out = len(self.seen), []
            for name, kind, agg in zip((f"v{i}", f"t{i}"), ("double", "string"), _value(self.df, kpi)):
                if agg is not None:
                    self.aggs.append(agg.alias(name))
                out.append(F.lit(None).cast(kind) if agg is None else F.col(name))
            self.seen[key] = tuple(out)
        return self.seen[key]

    def one_row(self) -> DataFrame:
        return self.df.agg(*self.aggs)


def _basic_row(shared: _Pass, kpi: Kpi) -> dict[str, Column]:
    status, message = _status_of(shared.df, kpi)
    number, text = shared.take(kpi)
    none = F.lit(None).cast("double")
    return {"kpi_id": F.lit(kpi.kpi_id), "kpi_name": F.lit(kpi.name), "aggregation": F.lit(kpi.aggregation),
            "status": F.lit(status), "value": number, "value_text": text, "numerator_value": none,
            "denominator_value": none, "record_count": F.col("rows"), "message": F.lit(message)}


def kpi_basic(df: DataFrame, kpis: list[Kpi]) -> DataFrame:
    """kpi_id, kpi_name, aggregation, status, value, value_text, record_count, message."""
    shared = _Pass(df)
    rows = [_basic_row(shared, k) for k in kpis]
    return C.to_rows(shared.one_row(), rows).drop("numerator_value", "denominator_value")


def _ratio_row(shared: _Pass, kpi: Kpi, by_id: dict[str, Kpi]) -> dict[str, Column]:
    """The parts of a ratio; status 'ratio' means that the values decide (see _with_ratios)."""
    top, bottom = by_id.get(kpi.numerator_id), by_id.get(kpi.denominator_id)
    n = d = none = F.lit(None).cast("double")
    status = "ratio"
    if not kpi.numerator_id or not kpi.denominator_id:
        status = "invalid_definition"
    elif top is None or bottom is None:
        status = "missing_dependency"
    elif top.aggregation not in BASIC or bottom.aggregation not in BASIC:
        status = "invalid_definition"  # no nesting
    elif _status_of(shared.df, top)[0] != "ok":
        status = "dependency_error"
    else:
        n = shared.take(top)[0]
        if _status_of(shared.df, bottom)[0] == "ok":
            d = shared.take(bottom)[0]
        else:
            status = "dependency_error"
    return {"kpi_id": F.lit(kpi.kpi_id), "kpi_name": F.lit(kpi.name), "aggregation": F.lit("ratio"), "status": F.lit(status),
            "value": none, "value_text": F.lit(None).cast("string"), "numerator_value": n, "denominator_value": d,
            "record_count": F.col("rows"), "message": F.lit("")}


def _with_ratios(rows: DataFrame) -> DataFrame:
    """Divide on the result rows (one per KPI), after the aggregate."""
    n, d, ratio = F.col("numerator_value"), F.col("denominator_value"), F.col("status") == "ratio"
    rows = rows.withColumns({"numerator_value": _finite(n), "denominator_value": _finite(d)})
    rows = rows.withColumn("value", F.when(ratio, _finite(F.try_divide(n, d))).otherwise(F.col("value")))
    status = (F.when(~ratio, F.col("status")).when(n.isNull() | d.isNull(), "dependency_error").when(d == 0, "zero_denominator")
              .when(F.col("value").isNull(), "dependency_error").otherwise("ok"))
    return rows.withColumn("status", status)


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < INF, c)


def kpi_ratio(df: DataFrame, ratios: list[Kpi], by_id: dict[str, Kpi]) -> DataFrame:
    """kpi_id, kpi_name, status, value, numerator_value, denominator_value, record_count."""
    shared = _Pass(df)
    rows = [_ratio_row(shared, k, by_id) for k in ratios]
    return _with_ratios(C.to_rows(shared.one_row(), rows)).drop("aggregation", "value_text", "message")


@dataclass(frozen=True)
class Meaning:
    """Semantic definition of a KPI."""

    kpi_id: str
    business_definition: str
    aliases: tuple[str, ...] = ()
    enabled: bool = True


def kpi_board(df: DataFrame, kpis: list[Kpi], meanings: list[Meaning] = ()) -> DataFrame:
    """All enabled and valid KPIs, basic and ratio, in one pass, with their active semantic definition."""
    by_id = {k.kpi_id: k for k in kpis}
    active: dict[str, Meaning] = {}
    for m in meanings:
        if m.enabled and m.kpi_id in by_id:
            active.setdefault(m.kpi_id, m)
    shared, rows = _Pass(df), []
    for i, kpi in enumerate(k for k in kpis if k.enabled and k.valid):
        raw = _ratio_row(shared, kpi, by_id) if kpi.aggregation == "ratio" else _basic_row(shared, kpi)
        meaning = active.get(kpi.kpi_id)
        rows.append({
            "position": F.lit(i), "category": F.lit(kpi.category), **raw,
            "business_definition": F.lit(meaning.business_definition if meaning else ""),
            "aliases": F.lit(",".join(meaning.aliases) if meaning else ""),
            "semantic_status": F.lit("linked" if meaning else "missing"),
        })
    board = _with_ratios(C.to_rows(shared.one_row(), rows))
    unusable = F.col("value").isNotNull() & _finite(F.col("value")).isNull()
    board = board.withColumn("status", F.when((F.col("status") == "ok") & unusable, "calculation_error").otherwise(F.col("status")))
    ok = F.col("status") == "ok"
    return board.select(
        "position", "kpi_id", "kpi_name", "category", "aggregation", F.when(ok, F.col("value")).alias("value"),
        F.when(ok, F.col("value_text")).alias("value_text"), "status", "record_count", "business_definition", "aliases", "semantic_status")


def kpi_board_counts(board: DataFrame) -> DataFrame:
    return board.agg(F.count(F.lit(1)).alias("usable"), F.count_if(F.col("status") == "ok").alias("calculated"),
                     F.count_if(F.col("status") != "ok").alias("failed"))


def candidate_id(name: str, aggregation: str, source: str, category: str) -> str:
    """The same definition always gets the same id."""
    return uuid.uuid5(ID_SPACE, "|".join((name, aggregation, source, category))).hex


CANDIDATE_SCHEMA = "kpi_id string, kpi_name string, aggregation string, source_field string, field_type string, category string"


def kpi_candidates(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidates from the confirmed field types and the column roles (both have one row per column)."""
    typed = {r["column"]: r["confirmed_type"] for r in mapping.select("column", "confirmed_type").collect()}
    typed = {c: t for c, t in typed.items() if t != "ignore"}
    roles = R.field_roles(df, confirmed={c: t for c, t in typed.items()}).collect()
    derived = {r["column"] for r in roles if r["role"] == "derived_time"}
    flat = {r["column"] for r in P.column_profile(df).filter("distinct_count <= 1").select("column").collect()}
    role = {r["column"]: r["role"] for r in roles}

    def of(kind: str) -> list[str]:
        return [c for c in df.columns if typed.get(c) == kind]

    out = [("record_count", "count_rows", "", "row", "core")]
    amounts = [c for c in of("amount") if not N.is_unit_price(c)]
    for i, c in enumerate(amounts):
        out.append(("sales_amount" if i == 0 else f"{c}_total", "sum", c, "amount", "core"))
        out.append((f"{c}_average", "avg", c, "amount", "core"))
    for c in df.columns:
        kind = typed.get(c)
        countable = role.get(c) == "numeric" or kind == "quantity"
        if (kind not in ("amount", "id", "date") and countable and role.get(c) not in (
                "identifier", "datetime", "derived_time", "constant", "boolean", "unsupported")
                and c not in flat | derived and N.is_additive_quantity(c)):
            out.append((c, "sum", c, "numeric", "core"))
    out += [(N.count_metric_name(c), "count_distinct", c, "id", "core") for c in of("id")]
    out += [(n, "reserved", c, "date", "time") for c in of("date") if c not in derived for n in ("yoy", "mom", "growth")]
    for kind in ("region", "product", "person"):
        out += [(f"sales_by_{kind}", "reserved", c, kind, "dimension") for c in of(kind)]
    unique = {(o[1], o[2], o[0], o[4]): o for o in out}
    rows = [(candidate_id(n, a, s, cat), n, a, s, t, cat) for n, a, s, t, cat in unique.values()]
    return df.sparkSession.createDataFrame(rows, CANDIDATE_SCHEMA)
