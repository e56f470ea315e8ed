"""Unions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, each, rounded, values
from tallyframe.operators import combine as A, joins as J
from tallyframe.operators.joins import Relationship
from tallyframe.plans import join_plan as JP
from tallyframe.session import scratch_path

R = Registry()


def _parts(d):
    o = d.orders
    early = o.filter("year(o_orderdate) < 1996").select("o_orderkey", "o_totalprice", "o_orderstatus")
    middle = o.filter("year(o_orderdate) BETWEEN 1996 AND 1998").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    late = o.filter("year(o_orderdate) > 1998").select("o_orderkey", "o_totalprice", "o_custkey")
    return {"early": early, "middle": middle, "late": late}


_FILLS = [A.Fill("o_custkey", "zero"), A.Fill("o_orderpriority", "mode"), A.Fill("o_orderstatus", "unknown")]


@R.add("append_tables", """WITH m AS (SELECT o_orderpriority AS v FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
 SELECT o_orderkey, o_totalprice, CASE WHEN year(o_orderdate) > 1998 THEN '未知' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1998 THEN o_orderpriority ELSE v END AS o_orderpriority,
 CASE WHEN year(o_orderdate) > 1998 THEN o_custkey ELSE 0 END AS o_custkey FROM orders, m""")
def _(d):
    return A.append_tables(_parts(d), _FILLS)


@R.add("append_audit", """SELECT CASE WHEN year(o_orderdate) < 1996 THEN 'early' WHEN year(o_orderdate) <= 1998 THEN 'middle' ELSE 'late' END AS source,
 count(*) AS "rows", CASE WHEN source = 'middle' THEN 4 ELSE 3 END AS columns,
 CASE source WHEN 'early' THEN 'o_orderpriority,o_custkey' WHEN 'middle' THEN 'o_custkey' ELSE 'o_orderstatus,o_orderpriority' END AS missing_fields,
 CASE source WHEN 'early' THEN '' WHEN 'middle' THEN 'o_orderpriority' ELSE 'o_custkey' END AS only_here,
 'o_orderkey,o_totalprice' AS common_fields, true AS order_differs, CAST(0.55 AS DOUBLE) AS schema_similarity,
 true AS row_count_matches FROM orders GROUP BY ALL""")
def _(d):
    parts = _parts(d)
    return A.append_audit(parts, A.append_tables(parts, _FILLS))


@R.add("append_filled_fields", """SELECT * FROM (VALUES ('o_custkey', 'early,middle', 'zero', 'numeric'),
 ('o_orderpriority', 'early,late', 'mode', 'category'), ('o_orderstatus', 'late', 'unknown', 'category'))
 AS t(field, missing_in, strategy, field_type) WHERE (SELECT count(DISTINCT o_orderpriority) / count(*) FROM orders) <= 0.5""")
def _(d):
    return A.filled_fields(_parts(d), _FILLS)


def _tables(d):
    return {
        "orders": d.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                                  F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("order_date")),
        "customers": d.customer.select(F.col("c_custkey").alias("Customer_ID"), F.col("c_name").alias("name"),
                                       F.col("c_nationkey").alias("nation_id")),
        "nations": d.nation.select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("name"),
                                   F.col("n_regionkey").alias("region_id")),
    }


_SRC = {"order_id": "o_orderkey", "customer_id": "o_custkey", "amount": "o_totalprice", "order_date": "o_orderdate"}


@R.add("relationship_profile", "WITH p AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count(DISTINCT {s}) AS distinct_count, count(DISTINCT {s}) / count({s}) AS unique_ratio,
 count(*) AS row_count FROM orders""" for i, (c, s) in enumerate(_SRC.items())) + f""")
 SELECT p.position, p."column", dtype, type_family, mapped_type, distinct_count, unique_ratio, row_count FROM p JOIN {values([
     ('order_id', 'bigint', 'numeric', 'id'), ('customer_id', 'bigint', 'numeric', 'id'), ('amount', 'double', 'numeric', 'amount'),
     ('order_date', 'timestamp_ntz', 'datetime', 'date')], '"column", dtype, type_family, mapped_type').replace('AS t(', 'AS m(')}
 ON p."column" = m."column" """)
def _(d):
    return J.relationship_profile(_tables(d)["orders"])


@R.add("connectable_columns", """SELECT "column", 1 AS preference FROM (VALUES ('Customer_ID'), ('nation_id'), ('name')) AS t("column")
 WHERE "column" <> 'name' OR (SELECT count(DISTINCT c_name) / count(c_name) FROM customer) > 0.8""")
def _(d):
    return J.connectable_columns(J.relationship_profile(_tables(d)["customers"]))


@R.add("discover_relationships", """WITH u AS (SELECT (SELECT count(DISTINCT o_custkey) / count(o_custkey) FROM orders) AS oc,
 (SELECT count(DISTINCT c_custkey) / count(c_custkey) FROM customer) AS cc, (SELECT count(DISTINCT c_nationkey) / count(c_nationkey) FROM customer) AS cn,
 (SELECT count(DISTINCT n_nationkey) / count(n_nationkey) FROM nation) AS nn)
 SELECT 'orders' AS table_a, 'customer_id' AS field_a, 'customers' AS table_b, 'Customer_ID' AS field_b, 'many_to_one' AS relationship_type,
 90 + CASE WHEN abs(oc - cc) <= 0.2 THEN 10 ELSE 0 END AS score, 'accept' AS advice FROM u
 UNION ALL SELECT 'customers', 'nation_id', 'nations', 'nation_id', 'many_to_one', 90 + CASE WHEN abs(cn - nn) <= 0.2 THEN 10 ELSE 0 END, 'accept' FROM u
 UNION ALL SELECT 'customers', 'name', 'nations', 'name', 'many_to_one', 100, 'accept'""")
def _(d):
    return J.discover_in_tables(_tables(d))


def _stats_sql(a, f, b, g, extra="") -> str:
    return f"""SELECT (SELECT count(*) FROM {a}) AS left_rows, (SELECT count(*) FROM {b}) AS right_rows,
 (SELECT count(*) FILTER (WHERE {f} IN (SELECT {g} FROM {b})) / count({f}) FROM {a}) AS match_rate,
 (SELECT sum(greatest(1, coalesce(k, 0))) / count(*) FROM {a} LEFT JOIN (SELECT {g} AS g, count(*) AS k FROM {b} WHERE {g} IS NOT NULL GROUP BY 1) ON {f} = g) AS expansion_factor,
 (SELECT count(DISTINCT {f}) / count({f}) FROM {a}) AS left_unique_ratio, (SELECT count(DISTINCT {g}) / count({g}) FROM {b}) AS right_unique_ratio{extra}"""


@R.add("join_stats", _stats_sql("orders_keys", "o_custkey", "customer", "c_custkey", ", false AS missing_field"))
def _(d):
    return J.join_stats(d.orders_keys, "o_custkey", d.customer, "c_custkey")


_RISK = """CASE WHEN expansion_factor > 2 OR match_rate < 0.6 THEN 'high' WHEN expansion_factor > 1.2 OR match_rate < 0.85
 OR right_unique_ratio < 0.98 THEN 'medium' ELSE 'low' END AS risk"""


@R.add("join_risk", f"""WITH s AS ({_stats_sql('customer', 'c_custkey', 'orders_keys', 'o_custkey', ", false AS missing_field")})
 SELECT s.*, {_RISK} FROM s""")
def _(d):
    return J.join_risk(J.join_stats(d.customer, "c_custkey", d.orders_keys, "o_custkey")).drop("reasons")


_RELS = [Relationship("orders", "o_custkey", "customers", "c_custkey"),
         Relationship("customers", "c_custkey", "orders", "o_custkey", "one_to_many"),
         Relationship("customers", "c_nationkey", "nations", "n_nationkey"),
         Relationship("orders", "o_custkey", "ghost", "id")]
_PLAN = " UNION ALL ".join(
    f"SELECT {i} AS position, '{r.table_a}' AS table_a, '{r.field_a}' AS field_a, '{r.table_b}' AS table_b, '{r.field_b}' AS field_b, "
    f"'{r.kind}' AS relationship_type, * FROM ({_stats_sql(a, r.field_a, b, r.field_b)})"
    for i, (r, a, b) in enumerate(zip(_RELS, ["orders_keys", "customer", "customer"], ["customer", "orders_keys", "nation"])))


@R.add("join_plan", f"""WITH p AS ({_PLAN}) SELECT p.*, CASE WHEN expansion_factor > 2 OR match_rate < 0.6 THEN 'high'
 WHEN expansion_factor > 1.2 OR match_rate < 0.85 OR (relationship_type = 'many_to_one' AND right_unique_ratio < 0.98) THEN 'medium' ELSE 'low' END AS risk
 FROM p UNION ALL SELECT 3, 'orders', 'o_custkey', 'ghost', 'id', 'many_to_one', 0, 0, 0.0, 0.0, 0.0, 0.0, 'high'""")
def _(d):
    tables = {"orders": d.orders_keys, "customers": d.customer, "nations": d.nation}
    return J.join_plan(tables, _RELS).drop("reasons")


@R.add("join_health", f"""WITH p AS ({_PLAN}), h AS (
 SELECT table_a, table_b, 'match_rate_too_low' AS "check", 'high' AS risk FROM p WHERE round_even(match_rate * 100, 2) < 60
 UNION ALL SELECT table_a, table_b, 'match_rate_low', 'medium' FROM p WHERE round_even(match_rate * 100, 2) >= 60 AND round_even(match_rate * 100, 2) < 85
 UNION ALL SELECT table_a, table_b, 'row_expansion', CASE WHEN round_even(expansion_factor, 2) > 2 THEN 'high' ELSE 'medium' END FROM p WHERE round_even(expansion_factor, 2) > 1.2)
 SELECT * FROM h UNION ALL SELECT '*', '*', 'ok', 'low' WHERE NOT EXISTS (SELECT 1 FROM h)""")
def _(d):
    tables = {"orders": d.orders_keys, "customers": d.customer, "nations": d.nation}
    return J.join_health(J.join_plan(tables, _RELS[:3]))


@R.add("left_join", """SELECT o.*, k.c_custkey, k.o_totalprice AS o_totalprice__credit_lines FROM orders_keys o LEFT JOIN
 (SELECT CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_custkey END AS c_custkey, c_acctbal AS o_totalprice FROM customer) k
 ON o.o_custkey = k.c_custkey""")
def _(d):
    credit = d.customer.select(F.when(F.col("c_custkey") % 500 != 0, F.col("c_custkey")).alias("c_custkey"),
                               F.col("c_acctbal").alias("o_totalprice"))
    return J.left_join(d.orders_keys, credit, "o_custkey", "c_custkey", "credit lines")


_BUILD = [Relationship("customers", "c_custkey", "orders", "o_custkey", "one_to_many"),
          Relationship("customers", "c_nationkey", "nations", "n_nationkey"),
          Relationship("orders", "o_custkey", "customers", "c_custkey"),
          Relationship("nations", "n_regionkey", "regions", "r_regionkey"),
          Relationship("nations", "no_field", "ghost", "id")]


def _build_tables(d):
    return {"orders": d.orders_keys, "customers": d.customer, "nations": d.nation, "regions": d.region}


@R.add("build_analysis_dataset", """SELECT * FROM orders_keys LEFT JOIN customer ON o_custkey = c_custkey
 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(d):
    return JP.build_analysis_dataset("orders", _build_tables(d), _BUILD, scratch_path(d.spark, "analysis"))[0]


@R.add("build_analysis_audit", """WITH j AS (SELECT * FROM orders_keys LEFT JOIN customer ON o_custkey = c_custkey),
 s AS (SELECT count(*) AS n, count(*) - count(o_custkey) AS k, count(*) - count(c_custkey) AS m FROM j)
 SELECT 0 AS position, 'customers' AS right_table, true AS applied, n AS rows_before, n AS rows_after, 1.0::DOUBLE AS row_expansion, k AS nulls_before, k + 5 * m AS nulls_after FROM s
 UNION ALL SELECT 1, 'nations', true, n, n, 1.0, k + 5 * m, k + 8 * m FROM s
 UNION ALL SELECT 2, 'customers', false, NULL, NULL, NULL, NULL, NULL
 UNION ALL SELECT 3, 'regions', true, n, n, 1.0, k + 8 * m, k + 10 * m FROM s
 UNION ALL SELECT 4, 'ghost', false, NULL, NULL, NULL, NULL, NULL""")
def _(d):
    audit = JP.build_analysis_dataset("orders", _build_tables(d), _BUILD)[1]
    return audit.drop("left_field", "right_field", "reason", "warnings")


@R.add("inner_join", "SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(d):
    return J.inner_join(d.lineitem, d.orders, "l_orderkey", "o_orderkey", "orders").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "o_custkey", "o_totalprice")


__all__ = ["R", "each", "rounded"]
