"""KPI definitions."""

from __future__ import annotations

from tallyframe.catalog.base import Registry, rounded, values
from tallyframe.operators import joins as J, kpi as K, roles as T
from tallyframe.operators.kpi import Kpi, Meaning

R = Registry()
BASICS = [Kpi("k1", "revenue", "sum", "l_extendedprice"), Kpi("k2", "average quantity", "avg", "l_quantity"),
          Kpi("k3", "rows", "count_rows"), Kpi("k4", "filled flags", "count", "l_returnflag"),
          Kpi("k5", "orders", "count_distinct", "l_orderkey"), Kpi("k6", "last ship date", "max", "l_shipdate"),
          Kpi("k7", "least quantity", "min", "l_quantity"), Kpi("k8", "ghost", "sum", "ghost"),
          Kpi("k9", "later", "reserved", "l_shipdate"), Kpi("k10", "odd", "median", "l_quantity"),
          Kpi("k11", "no source", "sum"), Kpi("k12", "nothing", "sum", "empty_col"), Kpi("k13", "no average", "avg", "empty_col")]
_BASIC_SQL = """WITH b AS (SELECT * FROM (
 SELECT 'k1' AS kpi_id, 'ok' AS status, (SELECT round(sum(l_extendedprice), 2) FROM lineitem_dirty) AS "value", CAST(NULL AS VARCHAR) AS value_text
 UNION ALL SELECT 'k2', 'ok', (SELECT round(avg(l_quantity), 2) FROM lineitem_dirty), NULL
 UNION ALL SELECT 'k3', 'ok', (SELECT count(*) FROM lineitem_dirty), NULL
 UNION ALL SELECT 'k4', 'ok', (SELECT count(l_returnflag) FROM lineitem_dirty), NULL
 UNION ALL SELECT 'k5', 'ok', (SELECT count(DISTINCT l_orderkey) FROM lineitem_dirty), NULL
 UNION ALL SELECT 'k6', 'ok', NULL, (SELECT strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem_dirty)
 UNION ALL SELECT 'k7', 'ok', (SELECT min(l_quantity) FROM lineitem_dirty), NULL
 UNION ALL SELECT 'k8', 'missing_field', NULL, NULL UNION ALL SELECT 'k9', 'unsupported', NULL, NULL
 UNION ALL SELECT 'k10', 'invalid_definition', NULL, NULL UNION ALL SELECT 'k11', 'invalid_definition', NULL, NULL
 UNION ALL SELECT 'k12', 'ok', 0, NULL UNION ALL SELECT 'k13', 'ok', NULL, NULL))"""


@R.add("kpi_basic", _BASIC_SQL + " SELECT b.*, (SELECT count(*) FROM lineitem_dirty) AS record_count FROM b")
def _(d):
    return rounded(K.kpi_basic(d.lineitem_dirty, BASICS).select("kpi_id", "status", "value", "value_text", "record_count"), 2)


RATIOS = [Kpi("r1", "price per order", "ratio", numerator_id="k1", denominator_id="k5"),
          Kpi("r2", "by nothing", "ratio", numerator_id="k1", denominator_id="k12"),
          Kpi("r3", "gone", "ratio", numerator_id="k1", denominator_id="nope"),
          Kpi("r4", "broken", "ratio", numerator_id="k8", denominator_id="k5"),
          Kpi("r5", "nested", "ratio", numerator_id="r1", denominator_id="k5"),
          Kpi("r6", "no value", "ratio", numerator_id="k13", denominator_id="k5")]
BY_ID = {k.kpi_id: k for k in BASICS + RATIOS}
_RATIO_SQL = """r AS (SELECT sum(l_extendedprice) AS s, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS o, count(*) AS n FROM lineitem_dirty),
 q AS (SELECT 'r1' AS kpi_id, 'ok' AS status, s / o AS "value", s AS numerator_value, o AS denominator_value FROM r
 UNION ALL SELECT 'r2', 'zero_denominator', NULL, s, 0 FROM r UNION ALL SELECT 'r3', 'missing_dependency', NULL, NULL, NULL
 UNION ALL SELECT 'r4', 'dependency_error', NULL, NULL, NULL UNION ALL SELECT 'r5', 'invalid_definition', NULL, NULL, NULL
 UNION ALL SELECT 'r6', 'dependency_error', NULL, NULL, o FROM r)"""


@R.add("kpi_ratio", f"""WITH {_RATIO_SQL} SELECT kpi_id, status, round("value", 2) AS "value", round(numerator_value, 2) AS numerator_value,
 denominator_value, (SELECT n FROM r) AS record_count FROM q""")
def _(d):
    return rounded(K.kpi_ratio(d.lineitem_dirty, RATIOS, BY_ID).drop("kpi_name"), 2)


@R.add("kpi_board", f"""{_BASIC_SQL}, {_RATIO_SQL}, a AS (SELECT kpi_id, round("value", 2) AS "value", value_text, status FROM b
 UNION ALL SELECT kpi_id, round("value", 2), NULL, status FROM q) SELECT a.*, (SELECT n FROM r) AS record_count,
 CASE kpi_id WHEN 'k1' THEN 'money in' WHEN 'r1' THEN 'order size' ELSE '' END AS business_definition,
 CASE kpi_id WHEN 'k1' THEN 'sales,turnover' ELSE '' END AS aliases,
 CASE WHEN kpi_id IN ('k1', 'r1') THEN 'linked' ELSE 'missing' END AS semantic_status FROM a WHERE kpi_id <> 'k4'""")
def _(d):
    off = [Kpi(**{**k.__dict__, "enabled": k.kpi_id != "k4"}) for k in BASICS + RATIOS]
    meanings = [Meaning("k2", "off", enabled=False), Meaning("k1", "money in", ("sales", "turnover")), Meaning("k1", "later one"),
                Meaning("r1", "order size"), Meaning("nope", "lost")]
    board = K.kpi_board(d.lineitem_dirty, off, meanings)
    return rounded(board.drop("position", "kpi_name", "category", "aggregation"), 2)


@R.add("kpi_board_counts", "SELECT CAST(19 AS BIGINT) AS usable, CAST(CASE WHEN count(*) > 0 THEN 10 ELSE 10 END AS BIGINT) AS calculated, "
                           "CAST(9 AS BIGINT) AS failed FROM lineitem_dirty")
def _(d):
    return K.kpi_board_counts(K.kpi_board(d.lineitem_dirty, BASICS + RATIOS))


def _orders(d):
    return J.inner_join(d.orders, d.customer, "o_custkey", "c_custkey").selectExpr(
        "o_orderkey AS order_id", "o_custkey AS customer_id", "o_totalprice AS sales_amount", "o_orderdate AS order_date",
        "o_orderkey % 7 AS item_quantity", "c_mktsegment AS product_line", "c_nationkey AS region_code", "o_totalprice AS unit_price")


@R.add("kpi_candidates", f"""SELECT * FROM {values([
    ('record_count', 'count_rows', '', 'row', 'core'), ('sales_amount', 'sum', 'sales_amount', 'amount', 'core'),
    ('sales_amount_average', 'avg', 'sales_amount', 'amount', 'core'), ('item_quantity', 'sum', 'item_quantity', 'numeric', 'core'),
    ('order_count', 'count_distinct', 'order_id', 'id', 'core'), ('customer_count', 'count_distinct', 'customer_id', 'id', 'core'),
    ('yoy', 'reserved', 'order_date', 'date', 'time'), ('mom', 'reserved', 'order_date', 'date', 'time'),
    ('growth', 'reserved', 'order_date', 'date', 'time'), ('sales_by_product', 'reserved', 'product_line', 'product', 'dimension'),
    ('sales_by_region', 'reserved', 'region_code', 'region', 'dimension')],
    'kpi_name, aggregation, source_field, field_type, category')} WHERE (SELECT count(DISTINCT o_orderkey % 7) FROM orders) > 1""")
def _(d):
    df = _orders(d)
    return K.kpi_candidates(df, T.infer_field_mapping(df)).drop("kpi_id")
