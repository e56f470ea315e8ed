"""Data-quality measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, each, rounded
from tallyframe.catalog.sources import DIRTY, dtype_case, monthly_sketches
from tallyframe.functions.columns import to_rows
from tallyframe.operators import outliers as O, quality as Q, sketches as S

R = Registry()
MEASURES = ["l_quantity", "l_extendedprice", "l_tax_sparse", "l_linenumber"]
PRICE = "l_extendedprice"
BOUNDS = """b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
 SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem_dirty))"""
R6 = '"column", ' + ", ".join(f"round({c}, 6) AS {c}" for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound"))
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def bounds_each(columns, view="lineitem_dirty") -> str:
    return each(columns, f"""SELECT '{{c}}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound,
 q3 + 1.5 * (q3 - q1) AS upper_bound FROM (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1,
 quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM {view})""")


def outliers_each(columns, view="lineitem_dirty") -> str:
    return each(columns, f"""SELECT * FROM (WITH k AS (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1,
 quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM {view})
 SELECT '{{c}}' AS "column", any_value(q1) AS q1, any_value(q3) AS q3, any_value(q3 - q1) AS iqr,
 any_value(q1 - 1.5 * (q3 - q1)) AS lower_bound, any_value(q3 + 1.5 * (q3 - q1)) AS upper_bound,
 count({{c}}) AS valid_count, count(*) FILTER (WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
 count(*) FILTER (WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) / greatest(count({{c}}), 1) * 100.0 AS outlier_pct
 FROM {view}, k)""")


@R.add("missing_summary", f"""WITH p AS ({each(DIRTY, '''SELECT '{c}' AS "column", count(*) AS total, count({c}) AS n
 FROM lineitem_dirty''')}), r AS (SELECT *, {dtype_case()} AS dtype, (total - n) / total AS ratio FROM p)
 SELECT "column", dtype, total - n AS missing_count, (total - n) / greatest(total, 1) * 100.0 AS missing_pct,
 CASE WHEN ratio >= 0.8 THEN 'drop_column' WHEN ratio >= 0.3 THEN 'fill_carefully' WHEN ratio = 0 THEN 'none'
 WHEN dtype LIKE 'timestamp%' THEN 'do_not_fill' WHEN dtype <> 'string' THEN 'mean_or_median' ELSE 'mode' END AS recommendation
 FROM r""")
def _(d):
    return Q.missing_summary(d.lineitem_dirty)


@R.add("missing_rows_preview", f"""SELECT * EXCLUDE (empty_col) FROM lineitem_dirty
 WHERE l_quantity IS NULL OR l_tax_sparse IS NULL OR l_returnflag IS NULL ORDER BY {', '.join(o + ' NULLS FIRST' for o in ORDER)} LIMIT 20""")
def _(d):
    return Q.missing_rows_preview(d.lineitem_dirty.drop("empty_col"), ORDER)


@R.add("duplicate_summary", """WITH g AS (SELECT count(*) AS k FROM lineitem_dups GROUP BY ALL, l_orderkey, l_partkey, l_suppkey,
 l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate),
 s AS (SELECT sum(k) AS t, sum(k - 1) AS e, coalesce(sum(k) FILTER (WHERE k > 1), 0) AS g FROM g)
 SELECT CAST(t AS BIGINT) AS total_rows, CAST(e AS BIGINT) AS extra_rows, CAST(g AS BIGINT) AS group_rows,
 e / greatest(t, 1) * 100.0 AS extra_ratio_pct, g / greatest(t, 1) * 100.0 AS group_ratio_pct FROM s""".replace("GROUP BY ALL, ", "GROUP BY "))
def _(d):
    return Q.duplicate_summary(d.lineitem_dups)


_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]


@R.add("duplicate_preview", f"""SELECT {', '.join(_ALL)} FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(_ALL)}) AS k
 FROM lineitem_dups) WHERE k > 1 ORDER BY {', '.join(_ALL)} LIMIT 50""")
def _(d):
    return Q.duplicate_preview(d.lineitem_dups, _ALL)


@R.add("iqr_bounds", f"SELECT {R6} FROM ({bounds_each(MEASURES)})")
def _(d):
    return rounded(O.iqr_bounds(d.lineitem_dirty, MEASURES), 6)


@R.add("sketch_iqr_bounds", each(MEASURES, """SELECT '{c}' AS "column", count({c}) AS valid_count, true AS q1_within_error, true AS q3_within_error FROM lineitem_dirty"""))
def _(d):
    bounds = {r["column"]: r for r in S.sketched_iqr_bounds(monthly_sketches(d)).filter(F.col("column").isin(MEASURES)).collect()}  # one row per column

    def within(column: str, share: float, quartile: str):
        value, found = F.col(column), F.lit(bounds[column][quartile])
        below, upto = F.count_if(value < found) / F.count(value), F.count_if(value <= found) / F.count(value)
        return (below <= share + S.RANK_ERROR) & (upto >= share - S.RANK_ERROR)

    one = d.lineitem_dirty.agg(*[x for i, c in enumerate(MEASURES) for x in (
        F.count(c).alias(f"n{i}"), within(c, 0.25, "q1").alias(f"a{i}"), within(c, 0.75, "q3").alias(f"b{i}"))])
    return to_rows(one, [{"column": F.lit(c), "valid_count": F.col(f"n{i}"), "q1_within_error": F.col(f"a{i}"), "q3_within_error": F.col(f"b{i}")}
                         for i, c in enumerate(MEASURES)])


@R.add("iqr_outliers", f"WITH {BOUNDS} SELECT l.* FROM lineitem_dirty l, b WHERE {PRICE} < lo OR {PRICE} > hi")
def _(d):
    return O.iqr_outliers(d.lineitem_dirty, PRICE)


@R.add("outlier_summary", f"SELECT {R6}, valid_count, outlier_count, round(outlier_pct, 6) AS outlier_pct FROM ({outliers_each(MEASURES)})")
def _(d):
    return rounded(O.outlier_summary(d.lineitem_dirty, MEASURES + ["l_partkey"], identifiers=["l_partkey"]), 6)


@R.add("outlier_context", f"""WITH {BOUNDS} SELECT l_orderkey, {PRICE}, l_shipdate, l_returnflag, l_partkey
 FROM lineitem_dirty, b WHERE {PRICE} < lo OR {PRICE} > hi""")
def _(d):
    return O.outlier_context(d.lineitem_dirty, PRICE, ["l_shipdate", "l_returnflag", "l_partkey"], "l_orderkey")


@R.add("outlier_export", f"""WITH {BOUNDS} SELECT l.* REPLACE (round({PRICE}, 6) AS {PRICE}), '{PRICE}' AS outlier_field, round({PRICE}, 6) AS outlier_value,
 round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, CASE WHEN {PRICE} < lo THEN 'below lower bound' ELSE 'above upper bound' END AS outlier_reason
 FROM lineitem_dirty l, b WHERE {PRICE} < lo OR {PRICE} > hi""")
def _(d):
    return rounded(O.outlier_export(d.lineitem_dirty, PRICE), 6)


@R.add("outlier_by_date", f"""WITH {BOUNDS} SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS outlier_count
 FROM lineitem_dirty, b WHERE {PRICE} < lo OR {PRICE} > hi GROUP BY 1""")
def _(d):
    return O.outlier_by_date(d.lineitem_dirty, PRICE, "l_shipdate")


@R.add("outlier_points", f"""WITH {BOUNDS} SELECT l_shipdate AS date, {PRICE} AS "value",
 CASE WHEN {PRICE} < lo OR {PRICE} > hi THEN 'outlier' ELSE 'normal' END AS status FROM lineitem_dirty, b
 WHERE {PRICE} IS NOT NULL""")
def _(d):
    return O.labelled_points(d.lineitem_dirty, PRICE, "l_shipdate")


_COUNTS = f"""o AS ({outliers_each(MEASURES)}), c AS (SELECT count(*) AS n,
 {' + '.join(f'(count(*) - count({c}))' for c in DIRTY)} AS missing FROM lineitem_dirty),
 x AS (SELECT (SELECT n FROM c) - count(*) AS extra FROM (SELECT DISTINCT * FROM lineitem_dirty)),
 s AS (SELECT n, missing, extra, (SELECT sum(outlier_count) FROM o) AS out, (SELECT sum(valid_count) FROM o) AS vals FROM c, x)"""


def _score(ids: int, weights) -> str:
    miss, dup, idp, inv, out = weights
    return f"""WITH {_COUNTS}, z AS (SELECT *, greatest(0, 100 - (least({miss}, round_even(missing / (n * 11) * 100, 0))
 + least({dup}, round_even(extra / n * 100, 0)) + {idp} + {inv} + least({out}, round_even(out / vals * 100, 0)))) AS score FROM s)
 SELECT CAST(score AS BIGINT) AS score, CAST(round_even(score / 20, 0) AS BIGINT) AS stars, CAST(missing AS BIGINT) AS missing_values,
 CAST(extra AS BIGINT) AS duplicate_rows, CAST({ids} AS BIGINT) AS identifier_columns, CAST(1 AS BIGINT) AS invalid_columns,
 CAST(out AS BIGINT) AS outlier_count FROM z"""


@R.add("quality_score_v1", _score(0, (30, 20, 0, 5, 25)))
def _(d):
    return Q.quality_score_v1(d.lineitem_dirty, ["empty_col"], MEASURES)


@R.add("quality_score_v2", _score(3, (30, 20, 9, 5, 15)))
def _(d):
    return Q.quality_score_v2(d.lineitem_dirty, ["l_orderkey", "l_partkey", "l_suppkey"], ["empty_col"], MEASURES)


def _suggest(view: str, extra: str) -> str:
    return f"""WITH p AS ({each(DIRTY, f'''SELECT '{{c}}' AS "column", (count(*) - count({{c}})) / count(*) AS r FROM {view}''')}),
 o AS ({outliers_each(MEASURES, view)})
 SELECT 'high_missing' AS finding, "column", 'high' AS severity, 'drop_or_refetch' AS "action", 'missing' AS handle_at FROM p WHERE r >= 0.8
 UNION ALL SELECT 'duplicate_rows', '*', 'medium', 'drop_duplicates', 'duplicates'
 FROM (SELECT count(*) AS n FROM {view}) t, (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {view})) u WHERE n > k
 UNION ALL SELECT 'identifier', 'l_orderkey', 'low', 'keep_out_of_statistics', 'identifiers'
 UNION ALL SELECT 'outliers', "column", 'medium', 'review_rows', 'outliers' FROM o WHERE outlier_count > 0 {extra}"""


@R.add("repair_suggestions", _suggest("lineitem_dirty", """
 UNION ALL SELECT 'invalid_column', 'empty_col', 'high', 'confirm_and_drop', 'missing'"""))
def _(d):
    return Q.repair_suggestions(d.lineitem_dirty, ["l_orderkey"], ["empty_col"], MEASURES)


@R.add("repair_suggestions_legacy", _suggest("lineitem_dirty", ""))
def _(d):
    return Q.repair_suggestions(d.lineitem_dirty, ["l_orderkey"], ["empty_col"], MEASURES, legacy=True)


@R.add("quality_sheet", f"""WITH p AS ({each(DIRTY, '''SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS m
 FROM lineitem_dirty''')}) SELECT 'rows' AS item, max(n) AS "value" FROM p UNION ALL SELECT 'columns', 11
 UNION ALL SELECT 'missing_total', CAST(sum(m) AS BIGINT) FROM p
 UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM lineitem_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_dirty))
 UNION ALL SELECT 'missing:' || "column", m FROM p WHERE m > 0""")
def _(d):
    return Q.quality_sheet(d.lineitem_dirty)


__all__ = ["R", "rounded"]
