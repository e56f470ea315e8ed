"""Sources, sinks, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, each, rounded
from tallyframe.functions.parsing import id_text
from tallyframe.operators import profiling as P, sketches as S
from tallyframe.session import scratch_path
from tallyframe.sources.readers import read_csv, read_dataset, read_events
from tallyframe.sources.sinks import redact, write_csv, write_events

R = Registry()
DIRTY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax_sparse",
         "empty_col", "l_returnflag", "const_col", "l_shipdate"]
DIRTY_TYPES = ["bigint", "int", "bigint", "bigint", "double", "double", "double", "double", "string", "string",
               "timestamp_ntz"]


def dtype_case(columns=DIRTY, types=DIRTY_TYPES) -> str:
    return "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in zip(columns, types)) + " END"


@R.add("src_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(d):
    path = scratch_path(d.spark, "customer_csv")
    write_csv(d.customer, path)
    return read_csv(d.spark, path, schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                                          "c_mktsegment string", enforceSchema="true")


@R.add("src_dataset", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(d):
    nation = read_dataset(d.spark, f"{d.sf_dir}/nation.parquet")
    region = read_dataset(d.spark, f"{d.sf_dir}/region.parquet")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def _log(d, properties="props"):
    return d.events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("user_id").cast("string").alias("session_id"), (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("duration_ms"), (F.col(properties) if isinstance(properties, str) else properties).alias("properties"))


@R.add("src_event_log", """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS event_name,
 CAST(user_id AS VARCHAR) AS session_id, event_type <> 'error' AS success, value AS duration_ms FROM events""")
def _(d):
    path = scratch_path(d.spark, "event_log")
    write_events(_log(d), path)
    return read_events(d.spark, path).select("event_id", "event_name", "session_id", "success", "duration_ms")


@R.add("sink_csv", "SELECT count(*) AS rows, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, "
                   "count(DISTINCT o_custkey) AS customers FROM orders")
def _(d):
    path = scratch_path(d.spark, "orders_csv")
    write_csv(d.orders, path)
    back = read_csv(d.spark, path, schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                          "o_totalprice double, o_orderdate string, o_orderpriority string")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                    F.count_distinct("o_custkey").alias("customers"))


@R.add("sink_events", """SELECT CAST(event_id AS VARCHAR) AS event_id,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '[redacted]' AS email, '[redacted]' AS inner_phone FROM events""")
def _(d):
    path = scratch_path(d.spark, "event_sink")
    private = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "user_email": "u'), F.col("user_id").cast("string"),
                       F.lit('@x.org", "o": {"phone": "'), F.col("user_id").cast("string"), F.lit('"}}'))
    write_events(_log(d, private), path)
    back = read_events(d.spark, path)
    j = lambda p: F.get_json_object("properties", p)
    return back.select("event_id", j("$.k").cast("bigint").alias("k"), j("$.user_email").alias("email"),
                       j("$.o.phone").alias("inner_phone"))


@R.add("preview_head_tail", """WITH h AS (SELECT 'head' AS part, * FROM orders ORDER BY o_orderkey LIMIT 20),
 t AS (SELECT 'tail' AS part, * FROM orders ORDER BY o_orderkey DESC LIMIT 20)
 SELECT * FROM h UNION ALL SELECT * FROM t""")
def _(d):
    head = P.head_rows(d.orders, ["o_orderkey"]).withColumn("part", F.lit("head"))
    tail = P.tail_rows(d.orders, ["o_orderkey"]).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


@R.add("sink_events_nested", """SELECT CAST(event_id AS VARCHAR) AS event_id, '[redacted]' AS phone, CAST(user_id AS VARCHAR) AS kept,
 '[redacted]' AS below FROM events""")
def _(d):
    path = scratch_path(d.spark, "event_sink_nested")
    user, six, ten = F.col("user_id").cast("string"), '{"o": ' * 5, '{"o": ' * 10
    nested = F.concat(F.lit('{"a": ' + six + '{"phone": "'), user, F.lit('", "n": "'), user, F.lit('"}' + "}" * 5 + ', "b": ' + ten + '{"email": "'),
                      user, F.lit('"}' + "}" * 10 + "}"))
    write_events(_log(d, nested), path)
    j = lambda p: F.get_json_object("properties", p)
    return read_events(d.spark, path).select("event_id", j("$.a" + ".o" * 5 + ".phone").alias("phone"), j("$.a" + ".o" * 5 + ".n").alias("kept"),
                                             j("$.b" + ".o" * 7).alias("below"))


@R.add("preview_sample", """SELECT * FROM lineitem ORDER BY md5(concat_ws('-', 42, l_orderkey, l_linenumber, l_partkey, l_suppkey)),
 l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 20""")
def _(d):
    return P.sample_rows(d.lineitem, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@R.add("field_profile", f"""WITH p AS ({each(DIRTY, '''SELECT '{c}' AS "column", count(*) AS total,
 count({c}) AS n, count(DISTINCT {c}) AS distinct_count FROM lineitem_dirty''')})
 SELECT "column", {dtype_case()} AS dtype, total - n AS missing_count,
 (total - n) / greatest(total, 1) * 100.0 AS missing_pct, distinct_count FROM p""")
def _(d):
    return P.field_profile(d.lineitem_dirty)


def monthly_sketches(d):
    """Sketches of lineitem_dirty by month: all months but the last are stored, then the last one is added."""
    path, by = scratch_path(d.spark, "sketches"), ["month"]
    lines = d.lineitem_dirty.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    last = lines.agg(F.max("month")).first()[0]
    S.store_sketches(S.partition_sketches(lines.filter(F.col("month") != last), by), path, by)
    S.store_sketches(S.partition_sketches(lines.filter(F.col("month") == last), by), path, by)
    return S.stored_sketches(d.spark, path)


@R.add("sketch_profile", f"""WITH p AS ({each(DIRTY, '''SELECT '{c}' AS "column", count(*) AS total,
 count({c}) AS n FROM lineitem_dirty''')})
 SELECT "column", {dtype_case()} AS dtype, total - n AS missing_count, round((total - n) / greatest(total, 1) * 100.0, 6) AS missing_pct,
 true AS distinct_within_error FROM p""")
def _(d):
    exact = P.field_profile(d.lineitem_dirty).select("column", F.col("distinct_count").alias("exact"))
    found = S.sketched_profile(monthly_sketches(d)).join(F.broadcast(exact), "column")  # one row per column
    within = F.abs(F.col("distinct_count") - F.col("exact")) <= 3 * F.col("distinct_error") * F.col("exact")
    return found.select("column", "dtype", "missing_count", F.round("missing_pct", 6).alias("missing_pct"), within.alias("distinct_within_error"))


@R.add("basic_info", """SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_dups)) AS duplicate_rows FROM lineitem_dups""")
def _(d):
    return P.basic_info(d.lineitem_dups)


_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_TXT = ["o_orderstatus", "o_orderpriority", "o_orderdate"]


@R.add("describe_all", each(_NUM, """SELECT '{c}' AS "column", count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique",
 round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS "min",
 round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS "max",
 CAST(NULL AS BIGINT) AS freq FROM orders""") + " UNION ALL " + each(_TXT, """SELECT '{c}' AS "column",
 count({c}) AS "count", count(DISTINCT {c}) AS "unique", CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
 CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
 (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {c})) AS freq FROM orders"""))
def _(d):
    return rounded(P.describe_all(d.orders).drop("top"))


@R.add("describe_top", each(["o_orderstatus", "o_orderpriority"], """SELECT * FROM (SELECT '{c}' AS "column", {c} AS top,
 count(*) AS freq, (SELECT count(DISTINCT {c}) FROM orders) AS "unique" FROM orders GROUP BY {c} ORDER BY 3 DESC, 2 LIMIT 1)"""))
def _(d):
    return P.top_values(d.orders, ["o_orderstatus", "o_orderpriority"])


@R.add("date_range", """SELECT 'l_shipdate' AS "column", CAST(min(l_shipdate) AS DATE) AS min_date,
 CAST(max(l_shipdate) AS DATE) AS max_date FROM lineitem""")
def _(d):
    return P.date_range(d.lineitem)


@R.add("exportable_cells", """SELECT o_orderkey, '{"k":' || o_custkey || ',"s":"' || o_orderstatus || '"}' AS nested,
 '[' || o_custkey || ',1]' AS list, o_orderdate FROM orders""")
def _(d):
    o = d.orders
    nested = o.select("o_orderkey", F.struct(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).alias("nested"),
                      F.array(F.col("o_custkey"), F.lit(1).cast("bigint")).alias("list"),
                      F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return P.exportable_cells(nested)


@R.add("id_text", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust_id,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 = 1 THEN ''
 ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS float_id FROM orders""")
def _(d):
    o = d.orders.withColumn("f", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey").cast("double"))
                            .when(F.col("o_orderkey") % 4 == 1, None).otherwise(F.col("o_orderkey") + F.lit(0.5)))
    return o.select("o_orderkey", id_text(o, "o_custkey").alias("cust_id"), id_text(o, "f").alias("float_id"))


__all__ = ["R", "redact"]
