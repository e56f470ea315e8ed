"""Query registration: a Spark callable per inventory ID and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.functions.columns import normalise_missing

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

# Views with missing, repeated and junk values; the same text runs in both engines.
VIEWS = {
    "lineitem_dirty": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN (l_orderkey + l_linenumber) % 20 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
 CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS l_extendedprice,
 CASE WHEN l_orderkey % 10 = 0 THEN l_tax END AS l_tax_sparse, CAST(NULL AS DOUBLE) AS empty_col,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, 'const' AS const_col,
 l_shipdate FROM lineitem""",
    "lineitem_dups": "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 0",
    "orders_text": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'bad'
 WHEN o_orderkey % 51 = 0 THEN NULL ELSE CAST(o_totalprice AS STRING) END AS amount_text,
 CASE WHEN o_orderkey % 60 = 0 THEN 'n/a'
 WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
 WHEN o_orderkey % 3 = 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/')
 ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 10:00:00') END AS date_text FROM orders""",
    "orders_keys": """SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN NULL
 WHEN o_orderkey % 41 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey,
 o_totalprice, o_orderdate, o_orderstatus FROM orders""",
    "event_log": """SELECT event_id, event_type AS event_name, user_id AS session_id, ts,
 event_type <> 'error' AS success, value AS duration_ms FROM events""",
    "event_tree": """SELECT event_id, event_type AS event_name, CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'broken {'
 WHEN event_id % 42 = 0 THEN '[1, [2, true]]' ELSE concat(substr(props, 1, length(props) - 1), ', "device": {"os": ',
 CASE WHEN event_id % 9 = 0 THEN 'null' WHEN event_id % 3 = 0 THEN '"linux"' ELSE '"android"' END, ', "mem": ', CAST(event_id % 7 AS STRING),
 CASE WHEN event_id % 2 = 0 THEN '.5' ELSE '' END, '}, "tags": [', CAST(event_id % 5 AS STRING), ', "x", {"z": null}]}') END AS properties FROM events""",
    "orders_gap": """SELECT * FROM orders WHERE NOT (year(o_orderdate) = 1996 AND month(o_orderdate) IN (3,4,5))
 AND NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 7)""",
    "orders_nd": """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS grp,
 year(o_orderdate) AS order_year, month(o_orderdate) AS order_month, o_orderkey % 2 = 0 AS is_even FROM orders""",
    "sales": """SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
 CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE c.c_mktsegment END AS segment, n.n_name AS nation, r.r_name AS region
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "questions": """SELECT o_orderkey AS question_id, CASE o_orderkey % 17
 WHEN 0 THEN concat('哪个区域的成交金额最高 ', n_name)
 WHEN 1 THEN concat('前', CAST(o_custkey % 9 + 1 AS STRING), '个产品的 Sales  Amount 排名')
 WHEN 2 THEN concat(n_name, '和', r_name, '哪个客户数更多')
 WHEN 3 THEN '各地区销售额占比是多少'
 WHEN 4 THEN concat('本月', n_name, '的订单数环比变化')
 WHEN 5 THEN concat('近 ', CAST(o_custkey % 11 + 1 AS STRING), ' 个月增长最快的前十二个产品')
 WHEN 6 THEN concat('利润最低的 ', CAST(o_custkey % 5 + 2 AS STRING), ' 个 ', c_mktsegment)
 WHEN 7 THEN '整体表现怎么样？'
 WHEN 8 THEN concat(r_name, '区域销售额排名是多少？产品利润趋势怎么样？')
 WHEN 9 THEN '销售额最高的是谁；客户数趋势分析'
 WHEN 10 THEN '小组和区域的成交金额分别是多少'
 WHEN 11 THEN '订单数最多的产品同时客户数最少的区域是哪个'
 WHEN 12 THEN concat('2024 年 ', CAST(o_custkey % 12 + 1 AS STRING), ' 月 TOP 3 sku')
 WHEN 13 THEN ''
 WHEN 14 THEN '销售额最高的前二十三名，又想看利润趋势'
 WHEN 15 THEN concat('最近 ', CAST(o_custkey % 90 + 1 AS STRING), ' 天', c_mktsegment, '的每日turnover走势')
 ELSE concat('hello ', n_name) END AS question
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


class Data:
    """The tables of one directory: data.orders, data.view('orders_keys')."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{", "{{").replace("}", "}}")
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None):
        def register(fn):
            self.queries[key] = lambda spark, sf_dir, _fn=fn: _fn(_prepared(spark, sf_dir))
            if sql:
                self.oracle[key] = with_views(sql)
            return fn
        return register


def _prepared(spark: SparkSession, sf_dir: str) -> Data:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Data(spark, sf_dir)


def with_views(sql: str) -> str:
    """Prefix the views a text uses as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql.strip()
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def rounded(df: DataFrame, digits: int = 4, skip=()) -> DataFrame:
    """Round double columns so that summation order does not show."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def each(columns, template: str, sep: str = " UNION ALL ") -> str:
    """One SELECT per column; {c} is the column, {i} its position."""
    return sep.join(template.replace("{c}", c).replace("{i}", str(i)) for i, c in enumerate(columns))


def values(rows, names: str) -> str:
    """A VALUES list as a derived table."""
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({names})"


__all__ = ["Column", "Data", "Registry", "VIEWS", "each", "normalise_missing", "rounded", "values", "with_views"]
