"""Periods, growth, dimensions, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, rounded
from tallyframe.functions import periods as D
from tallyframe.operators import business as B
from tallyframe.operators.business import Fields, Ranking

R = Registry()
FIELDS = Fields(date="o_orderdate", amount="o_totalprice", order_id="o_orderkey", customer_id="o_custkey",
                dimensions=("nation", "segment", "region"))
COUNTED = Fields(date="o_orderdate", amount="o_totalprice", customer_count="heads", order_id="o_orderkey")
PRICE = ("round(coalesce(sum(o_totalprice), 0), 2) AS amount, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, "
         "round(coalesce(sum(o_totalprice) / nullif(count(DISTINCT o_orderkey), 0), 0), 2) AS unit_price")
LABEL = {
    "day": "strftime(p, '%Y-%m-%d')", "week": "strftime(p, '%Y-%m-%d') || '/' || strftime(p + INTERVAL 6 DAY, '%Y-%m-%d')",
    "month": "strftime(p, '%Y-%m')", "quarter": "year(p) || 'Q' || quarter(p)", "year": "CAST(year(p) AS VARCHAR)"}
BACK = {"day": ("1 DAY", "365 DAY"), "week": ("7 DAY", "364 DAY"), "month": ("1 MONTH", "12 MONTH"),
        "quarter": ("3 MONTH", "12 MONTH"), "year": ("1 YEAR", "1 YEAR")}


@R.add("biz_metric", f"SELECT {PRICE} FROM sales")
def _(d):
    return rounded(d.sales.agg(*B.all_metrics(d.sales, FIELDS)), 2)


def _growth(signed: bool) -> str:
    base = "pv" if signed else "abs(pv)"
    scale = "" if signed else " * 100"
    return f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) - 15000000 AS v FROM orders_gap GROUP BY 1),
 j AS (SELECT a.p, a.v, b.v AS pv FROM m a LEFT JOIN m b ON b.p = a.p - INTERVAL 1 MONTH)
 SELECT strftime(p, '%Y-%m') AS period, round(v, 2) AS "value", round(pv, 2) AS previous,
 round(CASE WHEN pv <> 0 THEN (v - pv) / {base}{scale} END, 4) AS growth FROM j"""


def _shifted(d):
    o = d.orders_gap
    months = o.groupBy(F.date_trunc("month", "o_orderdate").alias("o_orderdate")).agg(
        (F.sum("o_totalprice") - 15000000).alias("v"))
    return months


@R.add("growth", _growth(False))
def _(d):
    g = B.growth_by_period(_shifted(d), "o_orderdate", "month", "v")
    return g.select("period", F.round("value", 2).alias("value"), F.round("previous", 2).alias("previous"), F.round("growth", 4).alias("growth"))


@R.add("growth_signed", _growth(True))
def _(d):
    g = B.growth_by_period(_shifted(d), "o_orderdate", "month", "v", signed=True)
    return g.select("period", F.round("value", 2).alias("value"), F.round("previous", 2).alias("previous"), F.round("growth", 4).alias("growth"))


def _dash(unit: str) -> str:
    prev, ago = BACK[unit]
    per = f"""WITH t AS (SELECT date_trunc('{unit}', o_orderdate)::DATE AS p, sum(o_totalprice) AS amount, count(DISTINCT o_orderkey)::DOUBLE AS orders,
 count(DISTINCT o_custkey)::DOUBLE AS customers FROM orders_gap GROUP BY 1), u AS (SELECT *, amount / orders AS unit_price FROM t),
 c AS (SELECT max(date_trunc('{unit}', o_orderdate)::DATE) AS p FROM orders_gap WHERE o_orderdate < TIMESTAMP '1998-10-20'), """
    rows = " UNION ALL ".join(f"""SELECT '{m}' AS metric, {LABEL[unit]} AS current_period, (SELECT {m} FROM u WHERE u.p = c.p) AS v,
 (SELECT {m} FROM u WHERE u.p = (c.p - INTERVAL {prev})::DATE) AS pv, (SELECT {m} FROM u WHERE u.p = (c.p - INTERVAL {ago})::DATE) AS av FROM c"""
                              for m in ("amount", "orders", "customers", "unit_price"))
    return per + f"""r AS ({rows}) SELECT metric, current_period, round(v, 2) AS "value", round(pv, 2) AS previous, round(av, 2) AS year_ago,
 round(CASE WHEN pv <> 0 THEN (v - pv) / abs(pv) * 100 END, 4) AS mom, round(CASE WHEN av <> 0 THEN (v - av) / abs(av) * 100 END, 4) AS yoy FROM r"""


def _dashboard(unit):
    def run(d):
        o = d.orders_gap
        out = B.period_dashboard(o.filter("o_orderdate < TIMESTAMP_NTZ '1998-10-20'"), "o_orderdate", unit, FIELDS, history=o)
        return out.select("metric", "current_period", *[F.round(c, 2).alias(c) for c in ("value", "previous", "year_ago")],
                          *[F.round(c, 4).alias(c) for c in ("mom", "yoy")])
    return run


for _unit in D.UNITS:
    R.add("period_dashboard" if _unit == "month" else f"period_dashboard_{_unit}", _dash(_unit))(_dashboard(_unit))


@R.add("period_trend", f"""WITH t AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, {PRICE} FROM orders_gap GROUP BY 1)
 SELECT p AS period_start, strftime(p, '%Y-%m') AS period, amount, orders, customers, unit_price FROM t""")
def _(d):
    return rounded(B.period_trend(d.orders_gap, "o_orderdate", "month", FIELDS), 2)


@R.add("period_label", " UNION ALL ".join(f"""SELECT '{u}' AS unit, {LABEL[u]} AS label, count(*) AS n
 FROM (SELECT date_trunc('{u}', o_orderdate) AS p FROM orders) GROUP BY ALL""" for u in D.UNITS))
def _(d):
    start = [F.struct(F.lit(u).alias("unit"), D.period_label(D.period_start(F.col("o_orderdate"), u), u).alias("label")) for u in D.UNITS]
    return d.orders.select(F.inline(F.array(*start))).groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))


@R.add("dimension_analysis", "SELECT segment, count(DISTINCT o_custkey) AS customers FROM sales GROUP BY segment")
def _(d):
    return B.dimension_analysis(d.sales, "segment", "customers", FIELDS)


@R.add("dimension_topn", """SELECT row_number() OVER (ORDER BY amount DESC, nation) AS rank, nation, round(amount, 2) AS amount
 FROM (SELECT nation, sum(o_totalprice) AS amount FROM sales GROUP BY nation ORDER BY 2 DESC, 1 LIMIT 10)""")
def _(d):
    return rounded(B.dimension_topn(d.sales, "nation", "amount", FIELDS, 10), 2)


@R.add("dimension_topn_all", """SELECT row_number() OVER (ORDER BY orders DESC, o_custkey) AS rank, o_custkey, orders
 FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS orders FROM sales GROUP BY 1)""")
def _(d):
    return B.dimension_topn(d.sales, "o_custkey", "orders", FIELDS, None)


@R.add("dimension_share", """SELECT segment, round(amount, 2) AS amount, round(amount / sum(amount) OVER () * 100, 2) AS share_pct
 FROM (SELECT segment, sum(o_totalprice) AS amount FROM sales GROUP BY 1)""")
def _(d):
    return rounded(B.dimension_share(d.sales, "segment", "amount", FIELDS), 2)


@R.add("dimension_trend", """WITH top AS (SELECT segment FROM sales GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 3)
 SELECT strftime(o_orderdate, '%Y-%m') AS period, segment, round(sum(o_totalprice), 2) AS amount FROM sales s
 WHERE EXISTS (SELECT 1 FROM top WHERE top.segment IS NOT DISTINCT FROM s.segment) GROUP BY 1, 2""")
def _(d):
    return rounded(B.dimension_trend(d.sales, "o_orderdate", "segment", "amount", FIELDS, "month", 3), 2)


@R.add("dimension_trend_missing", """SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, segment, count(DISTINCT o_orderkey) AS orders
 FROM sales GROUP BY 1, 2""")
def _(d):
    return B.dimension_trend(d.sales, "o_orderdate", "segment", "orders", FIELDS, "quarter", None)


@R.add("ranking_query", """SELECT row_number() OVER (ORDER BY amount DESC, nation) AS rank, nation, round(amount, 2) AS amount FROM (
 SELECT nation, sum(o_totalprice) AS amount FROM sales WHERE o_orderdate >= (SELECT max(o_orderdate) FROM sales) - INTERVAL 5 MONTH
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""")
def _(d):
    return rounded(B.ranking_query(d.sales, Ranking("nation", "amount", 5, recent_months=6), FIELDS), 2)


def _grow(limit) -> str:
    top = "" if limit is None else f"LIMIT {limit}"
    return f"""WITH e AS (SELECT min(date_trunc('month', o_orderdate)) AS a, max(date_trunc('month', o_orderdate)) AS b FROM sales),
 g AS (SELECT nation, sum(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = a) AS f, sum(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = b) AS l
 FROM sales, e GROUP BY 1), h AS (SELECT nation, f, l, (l - f) / nullif(abs(f), 0) * 100 AS gr FROM g)
 SELECT row_number() OVER (ORDER BY gr DESC, nation) AS rank, nation, round(f, 2) AS first_value, round(l, 2) AS last_value, round(gr, 2) AS growth_pct
 FROM h WHERE gr IS NOT NULL ORDER BY gr DESC, nation {top}"""


@R.add("growth_ranking", _grow(None))
def _(d):
    return rounded(B.ranking_query(d.sales, Ranking("nation", "amount", None, growth=True), FIELDS), 2)


@R.add("growth_ranking_limit", _grow(3))
def _(d):
    return rounded(B.ranking_query(d.sales, Ranking("nation", "amount", 3, growth=True), FIELDS), 2)


@R.add("growth_ranking_many", _grow(5).replace("nation", "o_custkey"))
def _(d):
    many = Fields(date=FIELDS.date, amount=FIELDS.amount, order_id=FIELDS.order_id, dimensions=("o_custkey",))
    return rounded(B.ranking_query(d.sales, Ranking("o_custkey", "amount", 5, growth=True), many), 2)


@R.add("top1_lead", """WITH t AS (SELECT nation, sum(o_totalprice) AS v FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)
 SELECT (SELECT nation FROM t ORDER BY v DESC LIMIT 1) AS leader, round(max(v), 2) AS "value", round(min(v), 2) AS runner_up,
 round((max(v) - min(v)) / abs(min(v)) * 100, 2) AS lead_pct FROM t""")
def _(d):
    return rounded(B.top1_lead(B.dimension_topn(d.sales, "nation", "amount", FIELDS, 10), "nation", "amount"), 2)


@R.add("top1_share_risk", """WITH t AS (SELECT o_orderstatus AS s, sum(CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 1 END) AS v FROM orders GROUP BY 1),
 x AS (SELECT max(v)::DOUBLE AS m, max(v) / sum(v) AS sh FROM t)
 SELECT 'finding' AS kind, 'top_contributor' AS message_key, (SELECT s FROM t ORDER BY v DESC LIMIT 1) AS subject, m AS amount FROM x
 UNION ALL SELECT 'risk', 'high_concentration', (SELECT s FROM t ORDER BY v DESC LIMIT 1), sh FROM x WHERE sh > 0.5
 UNION ALL SELECT 'recommendation', 'widen_sources', (SELECT s FROM t ORDER BY v DESC LIMIT 1), sh FROM x WHERE sh > 0.5
 UNION ALL SELECT 'comparison', 'change_vs_previous', NULL, -25.5 UNION ALL SELECT 'risk', 'clear_decline', NULL, -25.5""")
def _(d):
    weighted = d.orders.groupBy(F.col("o_orderstatus").alias("s")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 9).otherwise(1)).alias("v"))
    return B.top1_share_risk(weighted, "s", "v", growth_rate=-25.5)


def _heads(d):
    return d.sales.withColumn("heads", F.col("o_custkey") % 4)


@R.add("summary_kpis", """WITH s AS (SELECT *, o_custkey % 4 AS heads FROM sales), m AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM s GROUP BY 1),
 c AS (SELECT max(p) AS p FROM m), k AS (SELECT (SELECT v FROM m WHERE m.p = c.p) AS v, coalesce((SELECT v FROM m WHERE m.p = c.p - INTERVAL 1 MONTH), 0) AS pv,
 coalesce((SELECT v FROM m WHERE m.p = c.p - INTERVAL 12 MONTH), 0) AS av FROM c)
 SELECT round(sum(o_totalprice), 2) AS amount, sum(heads)::DOUBLE AS customers, round(sum(o_totalprice) / nullif(sum(heads), 0), 2) AS unit_price,
 count(DISTINCT o_orderkey) AS orders, (SELECT round((v - pv) / nullif(pv, 0), 2) FROM k) AS mom, (SELECT round((v - av) / nullif(av, 0), 2) FROM k) AS yoy FROM s""")
def _(d):
    return rounded(B.summary_kpis(_heads(d), COUNTED), 2)


def _by(dim: str) -> str:
    return f"""SELECT coalesce({dim}, '未填写') AS {dim}, round(sum(o_totalprice), 2) AS amount, sum(o_custkey % 4)::DOUBLE AS customers,
 round(sum(o_totalprice) / nullif(sum(o_custkey % 4), 0), 2) AS unit_price, count(DISTINCT o_orderkey) AS orders FROM sales GROUP BY 1"""


@R.add("summary_by_region", _by("region"))
def _(d):
    return rounded(B.dimension_summary(_heads(d), "region", COUNTED), 2)


@R.add("summary_by_product", _by("segment"))
def _(d):
    return rounded(B.dimension_summary(_heads(d), "segment", COUNTED), 2)


def _tt(fmt: str, where: str) -> str:
    return f"""SELECT strftime(o_orderdate, '{fmt}') AS period, round(sum(o_totalprice), 2) AS amount, sum(o_custkey % 4)::DOUBLE AS customers,
 round(sum(o_totalprice) / nullif(sum(o_custkey % 4), 0), 2) AS unit_price, count(DISTINCT o_orderkey) AS orders FROM sales {where} GROUP BY 1"""


@R.add("summary_time_trend", _tt("%Y-%m", ""))
def _(d):
    return rounded(B.summary_time_trend(_heads(d), COUNTED), 2)


@R.add("periodic_sums", """WITH t AS (SELECT date_trunc('quarter', l_shipdate) AS p, round(sum(l_quantity), 2) AS l_quantity, round(sum(empty_col), 2) AS empty_col
 FROM lineitem_dirty GROUP BY 1 ORDER BY 1 DESC LIMIT 12) SELECT year(p) || 'Q' || quarter(p) AS period, l_quantity, empty_col FROM t""")
def _(d):
    return rounded(B.periodic_sums(d.lineitem_dirty, "l_shipdate", ["l_quantity", "empty_col"], "quarter", 12), 2)
