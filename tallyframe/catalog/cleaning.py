"""Cleaning operators over the dirty views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, rounded, values
from tallyframe.catalog.quality import BOUNDS, PRICE
from tallyframe.operators import cleaning as K, outliers as O
from tallyframe.plans import cleaning_plan as CP
from tallyframe.plans.cleaning_plan import DuplicateChoice, MissingChoice, Step
from tallyframe.session import scratch_path

R = Registry()
REST = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def picked(df, *more):
    return df.select(*KEYS, *more)


@R.add("drop_missing_rows", "SELECT * FROM lineitem_dirty WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
def _(d):
    return K.drop_missing_rows(d.lineitem_dirty, ["l_quantity", "l_returnflag"])


@R.add("drop_columns", "SELECT * EXCLUDE (const_col, l_tax_sparse) FROM lineitem_dirty")
def _(d):
    return K.drop_columns(d.lineitem_dirty, ["const_col", "l_tax_sparse", "no_such_column"])


@R.add("drop_high_missing", "SELECT * EXCLUDE (empty_col, l_tax_sparse) FROM lineitem_dirty")
def _(d):
    return K.drop_high_missing(d.lineitem_dirty, 0.8)


@R.add("fill_zero", f"SELECT {REST}, coalesce(l_quantity, 0) AS l_quantity FROM lineitem_dirty")
def _(d):
    return picked(K.fill_zero(d.lineitem_dirty, "l_quantity"), "l_quantity")


@R.add("fill_mean", f"""SELECT {REST}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM lineitem_dirty)), 6) AS l_quantity
 FROM lineitem_dirty""")
def _(d):
    return rounded(picked(K.fill_mean(d.lineitem_dirty, "l_quantity"), "l_quantity"), 6)


@R.add("fill_median", f"""SELECT {REST}, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_dirty)) AS l_quantity
 FROM lineitem_dirty""")
def _(d):
    return picked(K.fill_median(d.lineitem_dirty, "l_quantity"), "l_quantity")


@R.add("fill_mode", f"""SELECT {REST}, coalesce(l_returnflag, (SELECT l_returnflag FROM lineitem_dirty WHERE l_returnflag IS NOT NULL
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM lineitem_dirty""")
def _(d):
    return picked(K.fill_mode(d.lineitem_dirty, "l_returnflag"), "l_returnflag")


@R.add("fill_unknown", f"SELECT {REST}, coalesce(l_returnflag, '未知') AS l_returnflag FROM lineitem_dirty")
def _(d):
    return picked(K.fill_unknown(d.lineitem_dirty, "l_returnflag"), "l_returnflag")


@R.add("fill_custom", f"SELECT {REST}, coalesce(l_returnflag, 'X') AS l_returnflag FROM lineitem_dirty")
def _(d):
    return picked(K.fill_custom(d.lineitem_dirty, "l_returnflag", "X"), "l_returnflag")


@R.add("drop_duplicates", "SELECT DISTINCT * FROM lineitem_dups")
def _(d):
    return K.drop_duplicates(d.lineitem_dups)


@R.add("drop_rows_by_id", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(d):
    ids = d.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.drop_rows_by_id(d.orders, ids, "o_orderkey")


@R.add("outlier_drop", f"WITH {BOUNDS} SELECT l.* FROM lineitem_dirty l, b WHERE NOT coalesce({PRICE} < lo OR {PRICE} > hi, false)")
def _(d):
    return O.drop_outliers(d.lineitem_dirty, PRICE)


@R.add("outlier_winsorize", f"WITH {BOUNDS} SELECT {REST}, round(greatest(least({PRICE}, hi), lo), 6) AS {PRICE} FROM lineitem_dirty, b")
def _(d):
    return rounded(picked(O.winsorize(d.lineitem_dirty, PRICE), PRICE), 6)


@R.add("outlier_median", f"""WITH {BOUNDS} SELECT {REST}, CASE WHEN {PRICE} < lo OR {PRICE} > hi
 THEN round((SELECT quantile_cont({PRICE}, 0.5) FROM lineitem_dirty), 6) ELSE round({PRICE}, 6) END AS {PRICE} FROM lineitem_dirty, b""")
def _(d):
    return rounded(picked(O.outliers_to_median(d.lineitem_dirty, PRICE), PRICE), 6)


@R.add("outlier_quantile", f"""WITH {BOUNDS} SELECT {REST}, round(CASE WHEN {PRICE} < lo THEN (SELECT quantile_cont({PRICE}, 0.05) FROM lineitem_dirty)
 WHEN {PRICE} > hi THEN (SELECT quantile_cont({PRICE}, 0.95) FROM lineitem_dirty) ELSE {PRICE} END, 4) AS {PRICE} FROM lineitem_dirty, b""")
def _(d):
    return rounded(picked(O.outliers_to_quantile(d.lineitem_dirty, PRICE, 0.05, 0.95), PRICE))


@R.add("outlier_mark", f"""WITH {BOUNDS} SELECT {REST}, {PRICE}, coalesce({PRICE} < lo OR {PRICE} > hi, false) AS is_outlier_{PRICE}
 FROM lineitem_dirty, b""")
def _(d):
    return picked(O.mark_outliers(d.lineitem_dirty, PRICE), PRICE, f"is_outlier_{PRICE}")


@R.add("log1p", f"SELECT {REST}, round(ln(1 + l_quantity), 9) AS l_quantity_log1p FROM lineitem_dirty")
def _(d):
    return rounded(picked(K.log1p(d.lineitem_dirty, "l_quantity"), "l_quantity_log1p"), 9)


@R.add("equal_width_bins", f"""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem_dirty)
 SELECT {REST}, CAST(CASE WHEN l_quantity IS NULL THEN NULL ELSE coalesce(least(5, greatest(1,
 ceil((l_quantity - lo) / nullif((hi - lo) / 5, 0)))), 1) END AS INTEGER) AS l_quantity_bin FROM lineitem_dirty, e""")
def _(d):
    return picked(K.equal_width_bins(d.lineitem_dirty, "l_quantity", 5), "l_quantity_bin")


_STEPS = [Step("drop_high_missing", threshold=0.95), Step("fill", column="l_quantity", method="median"),
          Step("drop_missing_rows", columns=("l_returnflag",)), Step("outlier", column=PRICE, method="winsorize"),
          Step("drop_duplicates")]


@R.add("cleaning_plan", f"""WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM lineitem_dirty),
 s AS (SELECT {REST}, coalesce(l_quantity, med) AS l_quantity, {PRICE} AS p, l_tax_sparse, l_returnflag, const_col, l_shipdate
 FROM lineitem_dirty, m WHERE l_returnflag IS NOT NULL),
 b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM s))
 SELECT DISTINCT {REST}, l_quantity, round(greatest(least(p, hi), lo), 4) AS {PRICE}, l_tax_sparse, l_returnflag, const_col, l_shipdate FROM s, b""")
def _(d):
    return rounded(CP.apply_plan(d.lineitem_dirty, _STEPS))


@R.add("cleaning_audit", """WITH n AS (SELECT count(*) AS a, count(l_returnflag) AS b FROM lineitem_dirty),
 k AS (SELECT count(*) AS c FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 coalesce(l_quantity, 25) AS q, l_extendedprice, l_tax_sparse, l_returnflag, l_shipdate FROM lineitem_dirty WHERE l_returnflag IS NOT NULL))
 SELECT 1 AS step, 'drop_high_missing' AS kind, a AS rows_before, 11 AS columns_before, a AS rows_after, 10 AS columns_after, 'empty_col' AS dropped_columns FROM n
 UNION ALL SELECT 2, 'fill', a, 10, a, 10, '' FROM n UNION ALL SELECT 3, 'drop_missing_rows', a, 10, b, 10, '' FROM n
 UNION ALL SELECT 4, 'outlier', b, 10, b, 10, '' FROM n UNION ALL SELECT 5, 'drop_duplicates', b, 10, c, 10, '' FROM n, k""")
def _(d):
    return CP.audited_plan(d.lineitem_dirty, _STEPS)[1].drop("target", "method")


_CHOICES = [MissingChoice("l_quantity", "zero"), MissingChoice("empty_col", "drop_column"),
            MissingChoice("l_returnflag", "drop_rows"), MissingChoice("l_quantity", "mean"),
            MissingChoice("l_tax_sparse", "none")]


@R.add("missing_plan", f"""WITH t AS (SELECT count(*) AS n, count(*) - count(l_quantity) AS q, count(*) - count(l_tax_sparse) AS x,
 count(*) - count(l_returnflag) AS f FROM lineitem_dirty), k AS (SELECT count(*) AS n, count(*) - count(l_tax_sparse) AS x
 FROM lineitem_dirty WHERE l_returnflag IS NOT NULL)
 SELECT 'missing_values' AS metric, t.n + q + t.x + f AS "before", k.x AS "after" FROM t, k
 UNION ALL SELECT 'rows', t.n, k.n FROM t, k UNION ALL SELECT 'columns', 11, 10""")
def _(d):
    return CP.missing_effect(d.lineitem_dirty, _CHOICES)


@R.add("missing_plan_impact", f"""WITH t AS (SELECT count(*) - count(l_quantity) AS q, count(*) - count(l_returnflag) AS f FROM lineitem_dirty)
 SELECT c.*, CASE "column" WHEN 'empty_col' THEN 1 WHEN 'l_returnflag' THEN f WHEN 'l_quantity' THEN q ELSE 0 END AS expected
 FROM {values([(0, 'empty_col', 'drop_column', 'columns_removed'), (1, 'l_returnflag', 'drop_rows', 'rows_removed'),
               (2, 'l_quantity', 'mean', 'values_filled'), (3, 'l_tax_sparse', 'none', 'no_change')],
              'position, "column", method, effect').replace('AS t(', 'AS c(')}, t""")
def _(d):
    return CP.missing_impact(d.lineitem_dirty, _CHOICES)


_ALL_DUPS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
             "l_returnflag, l_linestatus, l_shipdate")


@R.add("duplicate_plan", f"""WITH g AS (SELECT count(*) AS k FROM lineitem_dups GROUP BY {_ALL_DUPS})
 SELECT CAST(sum(k) AS BIGINT) AS before_rows, count(*) AS after_rows, CAST(sum(k - 1) AS BIGINT) AS removed_rows,
 CAST(sum(k - 1) AS BIGINT) AS before_extra, CAST(0 AS BIGINT) AS after_extra,
 CAST(sum(k) FILTER (WHERE k > 1) AS BIGINT) AS before_group_rows, CAST(0 AS BIGINT) AS after_group_rows FROM g""")
def _(d):
    return CP.duplicate_effect(d.lineitem_dups, DuplicateChoice("drop_all"))


@R.add("duplicate_groups_left", f"SELECT {_ALL_DUPS} FROM lineitem_dups GROUP BY {_ALL_DUPS} HAVING count(*) > 1")
def _(d):
    return CP.rows_left_of_groups(d.lineitem_dups, DuplicateChoice("drop_all"))


@R.add("clean_dataset", """WITH n AS (SELECT count(*) AS a, count(l_quantity) AS b FROM lineitem_dirty),
 k AS (SELECT count(*) AS c FROM (SELECT DISTINCT * FROM lineitem_dirty WHERE l_quantity IS NOT NULL))
 SELECT 1 AS step, 'missing' AS action_group, a AS rows_before, b AS rows_after FROM n
 UNION ALL SELECT 2, 'missing', b, b FROM n UNION ALL SELECT 3, 'duplicate', b, c FROM n, k
 UNION ALL SELECT 4, 'outlier', c, c FROM k""")
def _(d):
    steps = [Step("drop_missing_rows", columns=("l_quantity",)), Step("fill", column="l_returnflag", method="unknown"),
             Step("drop_duplicates"), Step("outlier", column=PRICE, method="mark")]
    audit = CP.clean_dataset(d.lineitem_dirty, steps, scratch_path(d.spark, "cleaned"))
    return audit.select("step", "action_group", "rows_before", "rows_after")


@R.add("compare_before_after", """WITH t AS (SELECT count(*) AS n, 5 * count(*) - count(l_quantity) - count(l_tax_sparse) - count(empty_col)
 - count(l_returnflag) - count(l_extendedprice) AS m FROM lineitem_dirty),
 k AS (SELECT count(*) AS n, 4 * count(*) - count(l_tax_sparse) - count(empty_col) - count(l_returnflag) - count(l_extendedprice) AS m
 FROM lineitem_dirty WHERE l_quantity IS NOT NULL),
 u AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lineitem_dirty)),
 w AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lineitem_dirty WHERE l_quantity IS NOT NULL))
 SELECT 'rows' AS metric, t.n AS "before", k.n AS "after" FROM t, k UNION ALL SELECT 'columns', 11, 11
 UNION ALL SELECT 'missing_values', t.m, k.m FROM t, k UNION ALL SELECT 'duplicate_rows', t.n - u.d, k.n - w.d FROM t, k, u, w""")
def _(d):
    df = d.lineitem_dirty
    return K.compare_before_after(df, K.drop_missing_rows(df, ["l_quantity"]))


def _stats(src: str) -> str:
    return f"""(WITH v AS (SELECT {PRICE} AS v FROM {src}), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM v)
 SELECT CAST(count(*) AS DOUBLE) AS "rows", CAST(count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS DOUBLE) AS outliers,
 round(avg(v), 3) AS mean, round(median(v), 3) AS median, round(max(v), 3) AS "max", round(min(v), 3) AS "min",
 round(stddev_samp(v), 3) AS std, round(skewness(v), 3) AS skew, round(kurtosis(v), 3) AS kurtosis FROM v, q)"""


@R.add("compare_outlier_treatment", f"""WITH {BOUNDS}, c AS (SELECT greatest(least({PRICE}, hi), lo) AS {PRICE} FROM lineitem_dirty, b)
 SELECT x.metric, x."before", y."after" FROM (UNPIVOT {_stats('lineitem_dirty')} ON COLUMNS(*) INTO NAME metric VALUE "before") x
 JOIN (UNPIVOT {_stats('c')} ON COLUMNS(*) INTO NAME metric VALUE "after") y ON x.metric = y.metric""")
def _(d):
    df = d.lineitem_dirty
    return O.compare_treatment(df, O.winsorize(df, PRICE), PRICE)
