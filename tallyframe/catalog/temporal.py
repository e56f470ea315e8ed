"""Subtotals, moving sums, joins by time, row differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, rounded
from tallyframe.operators import row_diff, subtotals as S, temporal_joins as T
from tallyframe.operators.business import Fields

R = Registry()
FIELDS = Fields(date="o_orderdate", amount="o_totalprice", order_id="o_orderkey", customer_id="o_custkey")
QUARTERS = """SELECT l_suppkey AS price_supplier, p AS valid_from, CASE WHEN p < DATE '1998-01-01' THEN p + INTERVAL '3' MONTH END AS valid_to, list_price
 FROM (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS p, max(l_extendedprice) AS list_price FROM {lineitem} GROUP BY 1, 2)"""


@R.add("dimension_rollup", """SELECT strftime(p, '%Y-%m') AS period, region, segment, CASE grouping(p, region, segment) WHEN 0 THEN 'period+region+segment'
 WHEN 1 THEN 'period+region' WHEN 3 THEN 'period' ELSE 'total' END AS level, round(sum(o_totalprice), 2) AS amount
 FROM (SELECT *, date_trunc('month', o_orderdate) AS p FROM sales) GROUP BY ROLLUP (p, region, segment)""")
def _(d):
    return rounded(S.dimension_rollup(d.sales, "o_orderdate", ["region", "segment"], "amount", FIELDS), 2)


@R.add("dimension_rollup_sets", """SELECT year(p) || 'Q' || quarter(p) AS period, segment, CASE grouping(p, segment) WHEN 1 THEN 'period'
 WHEN 2 THEN 'segment' ELSE 'total' END AS level, count(DISTINCT o_custkey) AS customers
 FROM (SELECT *, date_trunc('quarter', o_orderdate) AS p FROM sales) GROUP BY GROUPING SETS ((p), (segment), ())""")
def _(d):
    return S.dimension_rollup(d.sales, "o_orderdate", ["segment"], "customers", FIELDS, "quarter", [["period"], ["segment"], []])


@R.add("moving_sum", """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, o_orderpriority, sum(o_totalprice) AS amount FROM orders_gap GROUP BY 1, 2)
 SELECT strftime(p, '%Y-%m') AS period, o_orderpriority, round(amount, 2) AS amount, round(sum(amount) OVER w, 2) AS moving_sum, count(*) OVER w AS present_periods
 FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY p RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW)""")
def _(d):
    return rounded(S.moving_metric(d.orders_gap, "o_orderdate", "amount", FIELDS, "month", 3, "o_orderpriority"), 2)


@R.add("as_of_join", """WITH bad AS (SELECT user_id, ts, max(event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1, 2)
 SELECT e.event_id, e.user_id, CASE WHEN b.ts >= e.ts - INTERVAL 5 DAY THEN b.last_error END AS last_error
 FROM events e ASOF LEFT JOIN bad b ON e.user_id = b.user_id AND e.ts >= b.ts""")
def _(d):
    bad = d.events.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("last_error"))
    asked = d.events.select("event_id", "user_id", "ts")
    return T.as_of_join(asked, bad, ["user_id"], "ts", "ts", ["last_error"], within="5 days").select("event_id", "user_id", "last_error")


@R.add("range_join", f"""WITH prices AS ({QUARTERS.format(lineitem="lineitem")})
 SELECT l_orderkey, l_linenumber, valid_from, list_price FROM lineitem JOIN prices ON l_suppkey = price_supplier
 AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)""")
def _(d):
    prices = d.spark.sql(QUARTERS, lineitem=d.lineitem).withColumnRenamed("price_supplier", "l_suppkey")
    lines = d.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    joined = T.range_join(lines, prices, ["l_suppkey"], "l_shipdate", "valid_from", "valid_to", ["valid_from", "list_price"])
    return joined.select("l_orderkey", "l_linenumber", "valid_from", "list_price")


COUNTS = """SELECT l_suppkey, l_quantity, l_returnflag, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM (
 SELECT 1 AS side, l_suppkey, l_quantity, l_returnflag FROM lineitem_dirty
 UNION ALL SELECT 2, l_suppkey, l_quantity, l_returnflag FROM lineitem_dups) GROUP BY 1, 2, 3"""
COMPARED = ["l_suppkey", "l_quantity", "l_returnflag"]


@R.add("rows_changed", f"""SELECT l_suppkey, l_quantity, l_returnflag, greatest(a - b, 0) AS removed, greatest(b - a, 0) AS added FROM ({COUNTS}) WHERE a <> b""")
def _(d):
    return row_diff.rows_changed(d.lineitem_dirty, d.lineitem_dups, COMPARED)


@R.add("rows_common", f"""SELECT l_suppkey, l_quantity, l_returnflag, least(a, b) AS common FROM ({COUNTS}) WHERE a > 0 AND b > 0""")
def _(d):
    return row_diff.rows_common(d.lineitem_dirty, d.lineitem_dups, COMPARED)


@R.add("diff_summary", f"""SELECT sum(a) AS rows_before, sum(b) AS rows_after, sum(least(a, b)) AS unchanged, sum(a - least(a, b)) AS removed,
 sum(b - least(a, b)) AS added, count(*) FILTER (a <> b) AS different_rows FROM ({COUNTS})""")
def _(d):
    return row_diff.diff_summary(d.lineitem_dirty, d.lineitem_dups, COMPARED)
