"""Column typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, each, rounded, values
from tallyframe.catalog.sources import DIRTY, DIRTY_TYPES
from tallyframe.functions import columns as C
from tallyframe.functions.parsing import parse_datetime
from tallyframe.operators import roles as T

R = Registry()
NUMBER_SQL = "CASE WHEN regexp_matches(amount_text, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST(amount_text AS DOUBLE) END"
DATE_SQL = ("coalesce(try_strptime(date_text, '%Y-%m-%d %H:%M:%S'), try_strptime(date_text, '%Y-%m-%d'), "
            "try_strptime(date_text, '%Y/%m/%d'))")
KEYS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("amount_text", "string"), ("date_text", "string")]


@R.add("parse_datetime", f"SELECT o_orderkey, {DATE_SQL} AS parsed FROM orders_text")
def _(d):
    t = d.orders_text
    return t.select("o_orderkey", parse_datetime(t, "date_text").alias("parsed"))


@R.add("to_numeric", f"SELECT o_orderkey, {NUMBER_SQL} AS amount FROM orders_text")
def _(d):
    t = d.orders_text
    return t.select("o_orderkey", C.as_double(t, "amount_text").alias("amount"))


@R.add("finite_numeric", "SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderkey % 5 > 1")
def _(d):
    odd = d.orders.withColumn("x", F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("inf"))).when(
        F.col("o_orderkey") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice")))
    return odd.select("o_orderkey", C.as_finite(odd, "x").alias("amount")).filter("amount IS NOT NULL")


@R.add("detect_types", f"""WITH s AS (SELECT count(*) AS n, count(date_text) AS nd, count({DATE_SQL}) AS pd,
 count(DISTINCT date_text) AS dd, count(amount_text) AS na, count(DISTINCT amount_text) AS da FROM orders_text)
 SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, 'numeric' AS detected UNION ALL SELECT 'o_custkey', 'bigint', 'numeric'
 UNION ALL SELECT 'amount_text', 'string', CASE WHEN da <= 50 OR da / na <= 0.2 THEN 'categorical' ELSE 'text' END FROM s
 UNION ALL SELECT 'date_text', 'string', CASE WHEN pd / nd >= 0.8 THEN 'datetime' WHEN dd <= 50 OR dd / nd <= 0.2
 THEN 'categorical' ELSE 'text' END FROM s""")
def _(d):
    return T.detect_types(d.orders_text)


@R.add("date_like_columns", f"""SELECT 'date_text' AS "column", 'values' AS source FROM orders_text
 GROUP BY ALL HAVING count({DATE_SQL}) / count(date_text) >= 0.8""")
def _(d):
    return T.date_like_columns(d.orders_text)


_MAP = [("o_orderkey", "bigint", "id", 0.82, "unique_values", "id"),
        ("o_custkey", "bigint", "other", 0.55, "no_rule", "id"),
        ("amount_text", "string", "id", 0.82, "unique_values", "id"),
        ("date_text", "string", "date", 0.95, "date_name", "date")]


@R.add("infer_field_mapping", f"""WITH u AS (SELECT count(DISTINCT o_orderkey) / count(o_orderkey) AS k,
 count(DISTINCT o_custkey) / count(o_custkey) AS c, count(DISTINCT amount_text) / count(amount_text) AS a,
 count(DISTINCT o_custkey) AS dc, count(*) AS n FROM orders_text), m AS (SELECT * FROM {values([
     (c, t) for c, t in KEYS], '"column", dtype')})
 SELECT "column", dtype,
 CASE "column" WHEN 'date_text' THEN 'date' WHEN 'o_orderkey' THEN CASE WHEN k > 0.8 THEN 'id' ELSE 'other' END
 WHEN 'amount_text' THEN CASE WHEN a > 0.8 THEN 'id' ELSE 'category' END ELSE CASE WHEN c > 0.8 THEN 'id'
 WHEN dc <= least(20, greatest(5, floor(n * 0.1))) THEN 'category' ELSE 'other' END END AS inferred_type,
 CAST(CASE "column" WHEN 'date_text' THEN 0.95 WHEN 'o_orderkey' THEN CASE WHEN k > 0.8 THEN 0.82 ELSE 0.55 END
 WHEN 'amount_text' THEN CASE WHEN a > 0.8 THEN 0.82 ELSE 0.75 END ELSE CASE WHEN c > 0.8 THEN 0.82
 WHEN dc <= least(20, greatest(5, floor(n * 0.1))) THEN 0.75 ELSE 0.55 END END AS DOUBLE) AS confidence,
 CASE "column" WHEN 'o_custkey' THEN 'id' WHEN 'date_text' THEN 'date' WHEN 'o_orderkey' THEN CASE WHEN k > 0.8 THEN 'id'
 ELSE 'other' END ELSE CASE WHEN a > 0.8 THEN 'id' ELSE 'category' END END AS confirmed_type FROM m, u""")
def _(d):
    return T.infer_field_mapping(d.orders_text, {"o_custkey": "id"}).drop("reason")


def _id_sql(view, cols, types, named, measures):
    case = "CASE " + " ".join(
        [f"WHEN \"column\" = '{c}' THEN 'name'" for c in named]) + " " if named else "CASE "
    blocked = ", ".join(f"'{m}'" for m in measures) or "''"
    return (f"WITH p AS (" + each(cols, f"""SELECT '{{c}}' AS "column", count(*) AS total, count({{c}}) AS non_null,
 count(DISTINCT {{c}}) AS distinct_count FROM {view}""") + f""") SELECT "column", CASE "column" """
            + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in zip(cols, types))
            + f""" END AS dtype, non_null, distinct_count, reason FROM (SELECT *, {case} WHEN "column" NOT IN ({blocked})
 AND non_null > 0 AND distinct_count / non_null > 0.9 THEN 'unique' END AS reason FROM p) WHERE reason IS NOT NULL""")


CUST = [("customer_id", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
        ("c_mktsegment", "string")]


def _customers(d):
    return d.customer.withColumnRenamed("c_custkey", "customer_id")


_CUST_VIEW = "(SELECT c_custkey AS customer_id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"


@R.add("identifier_strict", _id_sql(_CUST_VIEW, [c for c, _ in CUST], [t for _, t in CUST], ["customer_id"], ["c_acctbal"]))
def _(d):
    return T.identifier_strict(_customers(d))  # c_acctbal is left out because its values are not whole numbers


@R.add("identifier_wide", _id_sql(_CUST_VIEW, [c for c, _ in CUST if c != "c_name"],
                                  [t for c, t in CUST if c != "c_name"], ["customer_id"], [])
       + " UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), count(DISTINCT c_mktsegment), 'manual' FROM customer")
def _(d):
    return T.identifier_wide(_customers(d), manual_ids=["c_mktsegment"], manual_non_ids=["c_name"])


@R.add("identifier_summary", f"""SELECT 'customer_id' AS "column", 'bigint' AS dtype,
 count(DISTINCT customer_id) AS distinct_count, count(DISTINCT customer_id) / greatest(count(customer_id), 1) * 100.0 AS unique_pct,
 'name' AS reason FROM {_CUST_VIEW} UNION ALL SELECT 'c_name', 'string', count(DISTINCT c_name),
 count(DISTINCT c_name) / greatest(count(c_name), 1) * 100.0, 'unique' FROM customer""")
def _(d):
    return T.identifier_summary(T.identifier_strict(_customers(d)))


@R.add("invalid_columns", "WITH p AS (" + each(DIRTY, """SELECT '{c}' AS "column",
 (count(*) - count({c})) / greatest(count(*), 1) * 100.0 AS missing_pct FROM lineitem_dirty""") + """)
 SELECT "column", missing_pct, 'mostly_missing' AS reason FROM p WHERE missing_pct >= 95""")
def _(d):
    return T.invalid_columns(d.lineitem_dirty)


@R.add("derived_time_column", """SELECT 'order_year' AS "column", 'year' AS part,
 avg(CASE WHEN order_year BETWEEN 1000 AND 9999 THEN 1 ELSE 0 END) AS match_ratio, true AS is_derived_time FROM orders_nd
 UNION ALL SELECT 'order_month', 'month', avg(CASE WHEN order_month BETWEEN 1 AND 12 THEN 1 ELSE 0 END), true FROM orders_nd""")
def _(d):
    return T.derived_time_columns(d.orders_nd)


_ROLES = [(0, "l_orderkey", "bigint", "identifier", "identifier"), (1, "l_linenumber", "int", "numeric", None),
          (2, "l_partkey", "bigint", "identifier", "identifier"), (3, "l_suppkey", "bigint", "identifier", "identifier"),
          (4, "l_quantity", "double", "numeric", None), (5, "l_extendedprice", "double", "numeric", None),
          (6, "l_tax_sparse", "double", "numeric", None), (7, "empty_col", "double", "unsupported", "invalid_column"),
          (8, "l_returnflag", "string", "categorical", None), (9, "const_col", "string", "constant", "single_value"),
          (10, "l_shipdate", "timestamp_ntz", "datetime", "datetime")]
_IDS = ["l_orderkey", "l_partkey", "l_suppkey"]


@R.add("field_roles", f"""WITH d AS ({each([r[1] for r in _ROLES], '''SELECT '{c}' AS "column", count(DISTINCT {c}) AS k
 FROM lineitem_dirty''')}), m AS (SELECT * FROM {values(_ROLES, 'position, "column", dtype, expected, why')})
 SELECT position, m."column", dtype, CASE WHEN expected IN ('numeric', 'categorical') AND k = 1 THEN 'constant' ELSE expected
 END AS role, why AS reason, false AS date_confirmed_but_partial, expected = 'datetime' AS time_usable
 FROM m JOIN d ON m."column" = d."column" """)
def _(d):
    return T.field_roles(d.lineitem_dirty, identifiers=_IDS, invalid=["empty_col"])


@R.add("exploration_overview", """WITH d AS (SELECT count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem_dirty)
 SELECT 'row_count' AS item, CAST(n AS VARCHAR) AS "value", CAST(NULL AS VARCHAR) AS reason FROM d
 UNION ALL SELECT 'column_count', '11', NULL UNION ALL SELECT 'date_mode', 'single', NULL
 UNION ALL SELECT 'start_date', strftime(a, '%Y-%m-%d'), NULL FROM d UNION ALL SELECT 'end_date', strftime(b, '%Y-%m-%d'), NULL FROM d
 UNION ALL SELECT * FROM (VALUES ('numeric_count', '4', NULL), ('categorical_count', '1', NULL), ('datetime_count', '1', NULL),
 ('identifier_count', '3', NULL), ('excluded', 'l_orderkey', 'identifier'), ('excluded', 'l_partkey', 'identifier'),
 ('excluded', 'l_suppkey', 'identifier'), ('excluded', 'empty_col', 'invalid_column'), ('excluded', 'const_col', 'single_value'))""")
def _(d):
    df = d.lineitem_dirty
    return T.exploration_overview(df, T.field_roles(df, identifiers=_IDS, invalid=["empty_col"]))


@R.add("numeric_columns", each(["c_nationkey", "c_acctbal"], """SELECT '{c}' AS "column" FROM customer GROUP BY ALL
 HAVING count(DISTINCT {c}) / greatest(count({c}), 1) <= 0.9"""))
def _(d):
    df = _customers(d)  # identifiers by value: nearly unique numbers are none of the numeric columns
    found = T.identifier_names(T.identifier_wide(df, manual_non_ids=["c_name"]))
    return T.analysis_columns(df, identifiers=found).filter("kind = 'numeric'").select("column")


@R.add("categorical_columns", each(["c_name", "c_mktsegment"], """SELECT '{c}' AS "column" FROM customer GROUP BY ALL
 HAVING count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / greatest(count({c}), 1) <= 0.2"""))
def _(d):
    return T.analysis_columns(_customers(d), identifiers=["customer_id"]).filter("kind = 'categorical'").select("column")


__all__ = ["R", "rounded", "DIRTY_TYPES"]
