"""Filters, aggregation, top-k."""

from __future__ import annotations

from datetime import date

from tallyframe.catalog.base import Registry, rounded
from tallyframe.operators import query as Q
from tallyframe.operators.query import Intent

R = Registry()
AS_OF = date(1998, 5, 14)  # a Thursday inside the data


@R.add("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND CAST(o_custkey AS VARCHAR) = '7' OR false")
def _(d):
    return Q.filter_eq(d.orders, [("o_orderstatus", "==", "F"), ("o_custkey", "==", 7), ("ghost", "==", 1), ("o_orderkey", ">", 1)])


_RANGES = {"today": ("1998-05-14", "1998-05-14"), "yesterday": ("1998-05-13", "1998-05-13"),
           "this_week": ("1998-05-11", "1998-05-14"), "last_week": ("1998-05-04", "1998-05-10"),
           "this_month": ("1998-05-01", "1998-05-14"), "last_month": ("1998-04-01", "1998-04-30"),
           "last_30_days": ("1998-04-15", "1998-05-14")}


@R.add("filter_time_range", " UNION ALL ".join(
    f"SELECT '{k}' AS time_range, o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN '{a}' AND '{b}'"
    for k, (a, b) in _RANGES.items()))
def _(d):
    from functools import reduce

    from pyspark.sql import DataFrame, functions as F

    return reduce(DataFrame.unionByName, [
        Q.filter_time_range(d.orders, "o_orderdate", k, AS_OF).select(F.lit(k).alias("time_range"), "o_orderkey", "o_orderdate")
        for k in _RANGES])


@R.add("filter_time_slice", """SELECT * FROM orders WHERE year(o_orderdate) = 1997 AND quarter(o_orderdate) = 2 AND month(o_orderdate) = 5""")
def _(d):
    return Q.filter_time_slice(d.orders, "o_orderdate", year=1997, quarter=2, month=5)


@R.add("filter_recent_months", """SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 0 MONTH
 UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 MONTH""")
def _(d):
    a = Q.filter_recent_months(d.events, "ts", 1).select("event_id", "ts")
    b = Q.filter_recent_months(d.orders, "o_orderdate", 3).selectExpr("o_orderkey AS event_id", "o_orderdate AS ts")
    return a.unionByName(b)


_NUM = "TRY_CAST(CASE WHEN amount_text <> 'bad' THEN amount_text END AS DOUBLE)"


@R.add("agg_scalar", f"""SELECT * FROM (SELECT 'sum' AS aggregation, round(coalesce(sum({_NUM}), 0), 2) AS "value" FROM orders_text
 UNION ALL SELECT 'avg', round(avg({_NUM}), 2) FROM orders_text UNION ALL SELECT 'max', max({_NUM}) FROM orders_text
 UNION ALL SELECT 'min', min({_NUM}) FROM orders_text UNION ALL SELECT 'count', count(amount_text) FROM orders_text
 UNION ALL SELECT 'count_rows', count(*) FROM orders_text UNION ALL SELECT 'count_distinct', count(DISTINCT amount_text) FROM orders_text)""")
def _(d):
    from pyspark.sql import functions as F

    from tallyframe.functions import columns as C

    t = d.orders_text
    one = t.agg(*[Q.aggregate_column(t, "amount_text", a).cast("double").alias(a) for a in Q.AGGREGATIONS])
    return rounded(C.to_rows(one, [{"aggregation": F.lit(a), "value": F.col(a)} for a in Q.AGGREGATIONS]), 2)


@R.add("agg_group", """SELECT segment, round(sum(o_totalprice), 2) AS "value" FROM sales GROUP BY segment""")
def _(d):
    return rounded(Q.aggregate(d.sales, "o_totalprice", "sum", "segment"), 2)


@R.add("agg_group_distinct", """SELECT segment, count(DISTINCT o_custkey) AS "value" FROM sales GROUP BY segment""")
def _(d):
    return Q.aggregate(d.sales, "o_custkey", "count_distinct", "segment")


@R.add("sort_limit", """SELECT nation, count(*) AS "value" FROM sales GROUP BY nation ORDER BY 2, 1 LIMIT 7""")
def _(d):
    return Q.sort_limit(Q.aggregate(d.sales, None, "count_rows", "nation"), "value", "asc", 7, ["nation"])


_INTENT = Intent(metric="o_totalprice", dimension="nation", aggregation="mean", filters=(("region", "==", "ASIA"), ("ghost", "==", 1)),
                 date_field="o_orderdate", time_range="last_400_days", as_of=AS_OF, sort="desc", top_n=3)
_WHERE = "region = 'ASIA' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-05-14' - 399 AND DATE '1998-05-14'"


@R.add("analysis_query", f"""SELECT nation, round(avg(o_totalprice), 2) AS "value" FROM sales WHERE {_WHERE} GROUP BY 1 ORDER BY avg(o_totalprice) DESC LIMIT 3""")
def _(d):
    return rounded(Q.analysis_query(d.sales, _INTENT).rows, 2)


@R.add("analysis_summary", f"""SELECT (SELECT count(*) FROM sales) AS original_rows, count(*) AS filtered_rows,
 least(3, count(DISTINCT nation)) AS result_rows, 'unknown_field:ghost' AS warnings FROM sales WHERE {_WHERE}""")
def _(d):
    return Q.analysis_query(d.sales, _INTENT).summary


@R.add("year_topn_query", """SELECT segment, round(max(o_totalprice), 2) AS "value" FROM sales WHERE year(o_orderdate) = 1996
 GROUP BY segment ORDER BY 2 DESC, 1 LIMIT 4""")
def _(d):
    return rounded(Q.year_topn_query(d.sales, "segment", "o_totalprice", "max", 4, "o_orderdate", 1996), 2)


@R.add("category_topn", """SELECT l_returnflag AS category, count(*) AS "count",
 count(*) / greatest((SELECT count(l_returnflag) FROM lineitem_dirty), 1) * 100.0 AS share_pct
 FROM lineitem_dirty WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2""")
def _(d):
    return Q.category_topn(d.lineitem_dirty, "l_returnflag", 2)


@R.add("trend", """SELECT l_shipdate AS date, round(sum(l_quantity), 2) AS "value" FROM lineitem_dirty WHERE l_quantity IS NOT NULL GROUP BY 1""")
def _(d):
    return rounded(Q.trend(d.lineitem_dirty, "l_shipdate", "l_quantity"), 2)
