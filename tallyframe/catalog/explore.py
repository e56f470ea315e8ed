"""Exploration statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyframe.catalog.base import Registry, each, rounded
from tallyframe.catalog.quality import bounds_each, outliers_each
from tallyframe.functions import columns as C
from tallyframe.operators import categories as G, correlation as K, numeric as N, report as E, timeline as L
from tallyframe.operators.timeline import read_span

R = Registry()
MEASURES = ["l_quantity", "l_extendedprice", "l_tax_sparse", "l_linenumber", "empty_col"]
MOMENTS = """round(avg({c}), 3) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS median, round(stddev_samp({c}), 3) AS std,
 round(CAST(min({c}) AS DOUBLE), 3) AS "min", round(CAST(max({c}) AS DOUBLE), 3) AS "max", round(skewness({c}), 3) AS skew, round(kurtosis({c}), 3) AS kurtosis"""


@R.add("numeric_summary", each(MEASURES, f"""SELECT '{{c}}' AS "column", {MOMENTS} FROM lineitem_dirty"""))
def _(d):
    return N.numeric_summary(d.lineitem_dirty, MEASURES)


@R.add("numeric_profile", f"""WITH s AS ({each(MEASURES, f'''SELECT '{{c}}' AS "column", {MOMENTS},
 (count(*) - count({{c}})) / count(*) * 100 AS missing_pct FROM lineitem_dirty''')}), o AS ({outliers_each(MEASURES)})
 SELECT s.*, outlier_pct FROM s JOIN o ON s."column" = o."column" """)
def _(d):
    return rounded(N.numeric_profile(d.lineitem_dirty, MEASURES), 3, skip=("missing_pct", "outlier_pct"))


_BINS = """CASE WHEN n < 2 OR lo = hi THEN 10 ELSE greatest(10, least(50, CASE WHEN q3 - q1 > 0
 THEN ceil(least((hi - lo) / nullif(2 * (q3 - q1) * pow(CAST(n AS DOUBLE), -1.0 / 3.0), 0), 50)) ELSE ceil(sqrt(n)) END)) END"""


def _facts(view: str) -> str:
    return each(MEASURES, f"""SELECT '{{c}}' AS "column", count(*) AS total, count({{c}}) AS n, count(DISTINCT {{c}}) AS d,
 coalesce(bool_and(abs({{c}} - round({{c}})) <= 1e-9), false) AS w, CAST(min({{c}}) AS DOUBLE) AS lo, CAST(max({{c}}) AS DOUBLE) AS hi,
 avg({{c}}) AS mean, stddev_samp({{c}}) AS std, skewness({{c}}) AS skew, kurtosis({{c}}) AS kurtosis,
 quantile_cont(CAST({{c}} AS DOUBLE), 0.1) AS p10, quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({{c}} AS DOUBLE), 0.5) AS p50,
 quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3, quantile_cont(CAST({{c}} AS DOUBLE), 0.9) AS p90 FROM {view}""")


_KIND = "CASE WHEN w AND d <= 30 THEN 'discrete' ELSE 'continuous' END"


@R.add("numeric_distribution", f"""WITH f AS ({_facts('lineitem_dirty')}) SELECT "column",
 CASE WHEN n > 0 AND d = 1 THEN 'constant' WHEN n < 5 THEN 'insufficient' ELSE 'ok' END AS status, {_KIND} AS distribution_type,
 total AS total_count, n AS valid_count, total - n AS excluded_count, d AS unique_count, round(mean, 4) AS mean, round(p50, 4) AS median, round(std, 4) AS std,
 round(lo, 4) AS "min", round(q1, 4) AS q1, round(q3, 4) AS q3, round(hi, 4) AS "max", round(p10, 4) AS p10, round(p90, 4) AS p90,
 round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, CASE WHEN {_KIND} = 'continuous' THEN CAST({_BINS} AS INTEGER) END AS bin_count FROM f""")
def _(d):
    return rounded(N.numeric_distribution(d.lineitem_dirty, MEASURES))


@R.add("distribution_type", f"""WITH f AS ({_facts('lineitem_dirty')}) SELECT "column", {_KIND} AS distribution_type FROM f""")
def _(d):
    return N.distribution_type(d.lineitem_dirty, MEASURES)


@R.add("discrete_frequency", """SELECT l_quantity AS "value", count(*) AS "count" FROM lineitem_dirty WHERE l_quantity IS NOT NULL GROUP BY 1""")
def _(d):
    return N.discrete_frequency(d.lineitem_dirty, "l_quantity")


@R.add("histogram_bins", f"""WITH f AS ({_facts('lineitem_dirty')}) SELECT "column", CAST({_BINS} AS INTEGER) AS bin_count FROM f""")
def _(d):
    return N.histogram_bins(d.lineitem_dirty, MEASURES)


@R.add("histogram", """WITH f AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem_dirty),
 b AS (SELECT CAST(least(19, floor((l_quantity - lo) / w)) AS INTEGER) AS bin, count(*) AS k FROM lineitem_dirty, f WHERE l_quantity IS NOT NULL GROUP BY 1)
 SELECT CAST(i AS INTEGER) AS bin, lo + i * w AS low, lo + (i + 1) * w AS high, coalesce(k, 0) AS "count" FROM range(20) r(i) CROSS JOIN f LEFT JOIN b ON bin = i""")
def _(d):
    return N.histogram(d.lineitem_dirty, "l_quantity", 20)


@R.add("box_stats", f"""WITH b AS ({bounds_each(MEASURES)}), s AS ({each(MEASURES, '''SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS "min",
 quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, CAST(max({c}) AS DOUBLE) AS "max",
 CAST(min({c}) FILTER (WHERE {c} >= lower_bound AND {c} <= upper_bound) AS DOUBLE) AS whisker_low,
 CAST(max({c}) FILTER (WHERE {c} >= lower_bound AND {c} <= upper_bound) AS DOUBLE) AS whisker_high,
 count(*) FILTER (WHERE {c} < lower_bound OR {c} > upper_bound) AS outlier_count FROM lineitem_dirty, b WHERE b."column" = '{c}' ''')})
 SELECT s."column", round("min", 6) AS "min", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round("max", 6) AS "max",
 round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, outlier_count FROM s JOIN b ON s."column" = b."column" """)
def _(d):
    return rounded(N.box_stats(d.lineitem_dirty, MEASURES), 6)


@R.add("box_points", f"""WITH b AS ({bounds_each(['l_extendedprice'])}) SELECT l_extendedprice AS "value", count(*) AS "count" FROM lineitem_dirty, b
 WHERE l_extendedprice < lower_bound OR l_extendedprice > upper_bound GROUP BY 1""")
def _(d):
    return N.box_points(d.lineitem_dirty, "l_extendedprice")


@R.add("distribution_reading", f"""WITH f AS ({_facts('lineitem_dirty')}), o AS ({outliers_each(MEASURES)})
 SELECT f."column", CASE WHEN n = 0 THEN 'no_values' WHEN abs(coalesce(skew, 0)) < 0.5 THEN 'symmetric' WHEN abs(skew) < 1 THEN
 CASE WHEN skew > 0 THEN 'mild_right_skew' ELSE 'mild_left_skew' END WHEN skew > 0 THEN 'strong_right_skew' ELSE 'strong_left_skew' END AS shape,
 CASE WHEN abs(mean - p50) / greatest(abs(p50), coalesce(std, 0), 1e-9) >= 0.1 THEN CASE WHEN mean > p50 THEN 'mean_pulled_up' ELSE 'mean_pulled_down' END
 ELSE 'none' END AS pull, coalesce(kurtosis > 3, false) AS heavy_tail, outlier_pct > 5 AS many_outliers FROM f JOIN o ON f."column" = o."column" """)
def _(d):
    return N.distribution_reading(d.lineitem_dirty, MEASURES)


# ---- categories ----------------------------------------------------------------------------------------
_COMP = """c AS (SELECT CAST({c} AS VARCHAR) AS category, count(*) AS k FROM {v} WHERE {c} IS NOT NULL GROUP BY 1), t AS (SELECT sum(k) AS n FROM c),
 r AS (SELECT row_number() OVER (ORDER BY k DESC, lower(category), category) AS rank, category, k,
 sum(k) OVER (ORDER BY k DESC, lower(category), category ROWS UNBOUNDED PRECEDING) AS upto FROM c)"""


def _comp(c: str, v: str) -> str:
    return _COMP.replace("{c}", c).replace("{v}", v)


@R.add("category_composition", f"""WITH {_comp('o_custkey', 'orders_keys')} SELECT rank, category, k AS "count", k / n AS ratio, upto / n AS cumulative_ratio FROM r, t""")
def _(d):
    return G.category_composition(d.orders_keys, "o_custkey")


def _comp_summary(c: str, v: str) -> str:
    return f"""SELECT 'ok' AS status, (SELECT count(*) FROM {v}) AS total_count, CAST(n AS BIGINT) AS valid_count, CAST((SELECT count(*) FROM {v}) - n AS BIGINT) AS excluded_count,
 (SELECT count(*) FROM r) AS category_count, (SELECT category FROM r WHERE rank = 1) AS top1_category, (SELECT k FROM r WHERE rank = 1) AS top1_count,
 (SELECT k FROM r WHERE rank = 1) / n AS top1_ratio, (SELECT sum(k) FROM r WHERE rank <= 5) / n AS top5_ratio,
 (SELECT count(*) FROM r WHERE k / n < 0.01) AS low_frequency_count, (SELECT coalesce(sum(k), 0) FROM r WHERE k / n < 0.01) / n AS low_frequency_ratio FROM t"""


@R.add("category_composition_summary", f"WITH {_comp('o_custkey', 'orders_keys')} {_comp_summary('o_custkey', 'orders_keys')}")
def _(d):
    return G.composition_summary(d.orders_keys, "o_custkey")


@R.add("category_topn_other", f"""WITH {_comp('n_name', '(SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)')}
 SELECT category, k AS "count", k / n AS ratio, false AS is_merged_other FROM r, t WHERE rank <= 6
 UNION ALL SELECT '其他（合并）', CAST(n - (SELECT sum(k) FROM r WHERE rank <= 6) AS BIGINT), (n - (SELECT sum(k) FROM r WHERE rank <= 6)) / n, true FROM t""")
def _(d):
    df = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return G.category_topn_other(df, "n_name", 6)


_LABELS = ["l_returnflag", "const_col"]


def _cats(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS d, max(k) AS f, sum(k) AS n, (SELECT sum(k) FROM (SELECT k FROM (SELECT count(*) AS k FROM lineitem_dirty
 WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY k DESC LIMIT 5)) AS five, min_by(v, (-k, v)) AS top FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM lineitem_dirty WHERE {c} IS NOT NULL GROUP BY 1)"""


@R.add("category_summary", f"""WITH s AS ({' UNION ALL '.join(_cats(c) for c in _LABELS)}) SELECT "column", top AS top_value, f AS top_count,
 f / greatest(n, 1) * 100.0 AS top_pct, d AS distinct_count FROM s""")
def _(d):
    return G.category_summary(d.lineitem_dirty, _LABELS)


@R.add("category_profile", f"""WITH s AS ({' UNION ALL '.join(_cats(c) for c in _LABELS)}) SELECT "column", d AS distinct_count, top AS top_value,
 f / greatest(n, 1) * 100.0 AS top1_pct, five / greatest(n, 1) * 100.0 AS top5_pct, CASE WHEN f / n * 100 >= 80 THEN 'high' WHEN f / n * 100 >= 50 THEN 'medium'
 ELSE 'scattered' END AS concentration FROM s""")
def _(d):
    return G.category_profile(d.lineitem_dirty, _LABELS)


# ---- time ----------------------------------------------------------------------------------------------
_UNIT_END = {"day": "p", "week": "p + INTERVAL 6 DAY", "month": "p + INTERVAL 1 MONTH - INTERVAL 1 DAY", "quarter": "p + INTERVAL 3 MONTH - INTERVAL 1 DAY",
             "year": "p + INTERVAL 1 YEAR - INTERVAL 1 DAY"}
_UNIT_LABEL = {"day": "strftime(p, '%Y-%m-%d')", "week": "strftime(p, '%Y-%m-%d') || ' ~ ' || strftime(p + INTERVAL 6 DAY, '%Y-%m-%d')",
               "month": "strftime(p, '%Y-%m')", "quarter": "year(p) || ' Q' || quarter(p)", "year": "CAST(year(p) AS VARCHAR)"}
_CAL = """k AS (SELECT date_trunc('month', o_orderdate) AS p, count(*) AS n FROM orders_gap GROUP BY 1),
 cal AS (SELECT unnest(generate_series((SELECT min(p) FROM k), (SELECT max(p) FROM k), INTERVAL 1 MONTH)) AS p),
 f AS (SELECT cal.p, coalesce(n, 0) AS n FROM cal LEFT JOIN k ON cal.p = k.p)"""


@R.add("time_distribution", f"""WITH {_CAL} SELECT CAST(p AS DATE) AS period_start, CAST({_UNIT_END['month']} AS DATE) AS period_end, {_UNIT_LABEL['month']} AS period_label,
 n AS "count", n / (SELECT count(*) FROM orders_gap) AS ratio FROM f""")
def _(d):
    return L.time_distribution(d.orders_gap, "o_orderdate", "month")


@R.add("time_distribution_summary", f"""WITH {_CAL}, s AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b, count(*) AS n,
 count(DISTINCT CAST(o_orderdate AS DATE)) AS act FROM orders_gap)
 SELECT CASE WHEN act = 1 THEN 'single_date' ELSE 'ok' END AS status, n AS total_count, n AS valid_count, CAST(0 AS BIGINT) AS excluded_count, a AS start_date, b AS end_date,
 CAST(b - a + 1 AS INTEGER) AS calendar_span_days, act AS active_date_count, CASE WHEN b - a + 1 <= 90 THEN 'day' WHEN b <= a + INTERVAL 2 YEAR THEN 'week'
 WHEN b <= a + INTERVAL 8 YEAR THEN 'month' ELSE 'year' END AS recommended, 'month' AS selected, (SELECT count(*) FROM f) AS period_count,
 (SELECT count(*) FROM k) AS active_period_count, (SELECT count(*) FROM f) - (SELECT count(*) FROM k) AS zero_period_count,
 (SELECT strftime(p, '%Y-%m') FROM k ORDER BY n DESC, p LIMIT 1) AS peak_period, (SELECT max(n) FROM k) AS peak_count FROM s""")
def _(d):
    return L.time_summary(d.orders_gap, "o_orderdate", "month")


_DAYS = """k AS (SELECT date_trunc('day', o_orderdate) AS p, count(*) AS n FROM orders_gap GROUP BY 1),
 cal AS (SELECT unnest(generate_series((SELECT min(p) FROM k), (SELECT max(p) FROM k), INTERVAL 1 DAY)) AS p),
 f AS (SELECT cal.p, coalesce(n, 0) AS n FROM cal LEFT JOIN k ON cal.p = k.p)"""


@R.add("time_distribution_days", f"""WITH {_DAYS} SELECT CAST(p AS DATE) AS period_start, CAST(p AS DATE) AS period_end, strftime(p, '%Y-%m-%d') AS period_label,
 n AS "count", n / (SELECT count(*) FROM orders_gap) AS ratio FROM f""")
def _(d):
    return L.time_distribution(d.orders_gap, "o_orderdate", "day")


@R.add("zero_ranges_days", f"""WITH {_DAYS}, g AS (SELECT p, n, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (ORDER BY p) AS g FROM f)
 SELECT strftime(min(p), '%Y-%m-%d') AS start_label, strftime(max(p), '%Y-%m-%d') AS end_label, CAST(min(p) AS DATE) AS start_date, CAST(max(p) AS DATE) AS end_date,
 count(*) AS period_count FROM g WHERE n = 0 GROUP BY g ORDER BY period_count DESC, start_date LIMIT 10""")
def _(d):
    return L.zero_ranges(L.time_distribution(d.orders_gap, "o_orderdate", "day"))


@R.add("time_too_dense", """SELECT 'too_dense' AS status, count(*) AS total_count, CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) + 1 AS period_count FROM orders""")
def _(d):
    return L.time_summary(d.orders, "o_orderdate", "day").select("status", "total_count", "period_count")


_SPAN = "SELECT '{c}' AS \"column\", CAST(min({c}) AS DATE) AS a, CAST(max({c}) AS DATE) AS b FROM {t}"


@R.add("time_granularity", f"""WITH s AS ({_SPAN.replace('{c}', 'l_shipdate').replace('{t}', 'lineitem')}) SELECT "column", a AS start_date, b AS end_date,
 CASE WHEN b - a + 1 <= 90 THEN 'day' WHEN b <= a + INTERVAL 2 YEAR THEN 'week' WHEN b <= a + INTERVAL 8 YEAR THEN 'month' ELSE 'year' END AS granularity FROM s""")
def _(d):
    return L.time_granularity(d.lineitem, ["l_shipdate"])


@R.add("period_bounds", " UNION ALL ".join(f"""SELECT DISTINCT '{u}' AS unit, CAST(p AS DATE) AS period_start, CAST({_UNIT_END[u]} AS DATE) AS period_end, {_UNIT_LABEL[u]} AS label
 FROM (SELECT date_trunc('{u}', o_orderdate) AS p FROM orders)""" for u in _UNIT_END))
def _(d):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [L.period_bounds(d.orders, "o_orderdate", u).withColumn("unit", F.lit(u)) for u in _UNIT_END])


@R.add("zero_ranges", f"""WITH {_CAL}, g AS (SELECT p, n, row_number() OVER (ORDER BY p) AS i FROM f), z AS (SELECT p, i - row_number() OVER (ORDER BY p) AS grp FROM g WHERE n = 0)
 SELECT strftime(min(p), '%Y-%m') AS start_label, strftime(max(p), '%Y-%m') AS end_label, CAST(min(p) AS DATE) AS start_date,
 CAST(max(p) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS end_date, count(*) AS period_count FROM z GROUP BY grp ORDER BY 5 DESC, 3 LIMIT 10""")
def _(d):
    return L.zero_ranges(L.time_distribution(d.orders_gap, "o_orderdate", "month"))


# ---- correlation ---------------------------------------------------------------------------------------
_NUM = ["l_quantity", "l_extendedprice", "l_tax_sparse", "l_linenumber", "price2"]
_WIDE = "w AS (SELECT *, l_extendedprice * 2 + l_quantity AS price2 FROM lineitem_dirty)"


def _wide(d):
    df = d.lineitem_dirty
    return df.withColumn("price2", F.col("l_extendedprice") * 2 + F.col("l_quantity"))


def _pairs(cols, view="w") -> str:
    return " UNION ALL ".join(f"""SELECT '{a}' AS field_a, '{b}' AS field_b, corr({a}, {b}) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {view}"""
                              for a, b in combinations(cols, 2))


def _labelled(threshold: float) -> str:
    return f"""SELECT field_a, field_b, round(r, 6) AS correlation, round(abs(r), 6) AS "absolute", CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction,
 CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'some' WHEN abs(r) < 0.7 THEN 'medium' ELSE 'strong' END AS strength, n AS sample_size,
 CASE WHEN n < 20 THEN 'small' ELSE 'normal' END AS sample_status, abs(r) >= 0.9999 AS near_complete FROM p WHERE n >= 5 AND abs(r) >= {threshold}"""


@R.add("correlation_pairs", f"WITH {_WIDE}, p AS ({_pairs(_NUM)}) {_labelled(0.0)}")
def _(d):
    return rounded(K.correlation_pairs(_wide(d), _NUM + ["empty_col", "const_col", "ghost"], threshold=0.0), 6)


@R.add("correlation_matrix", f"""WITH {_WIDE}, p AS ({_pairs(_NUM)}) SELECT field_a, field_b, round(r, 6) AS correlation, n AS sample_size FROM p
 UNION ALL SELECT field_b, field_a, round(r, 6), n FROM p UNION ALL {each(_NUM, "SELECT '{c}', '{c}', 1.0, count({c}) FROM w")}""")
def _(d):
    return rounded(K.correlation_matrix(_wide(d), _NUM), 6)


_RANKS = " UNION ALL ".join(f"""SELECT '{a}' AS field_a, '{b}' AS field_b, corr(ra, rb) AS r, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM lineitem_dirty WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in combinations(_NUM[:3], 2))


@R.add("spearman_rank", f"WITH p AS ({_RANKS}) {_labelled(0.0)}")
def _(d):
    return rounded(K.correlation_pairs(d.lineitem_dirty, _NUM[:3], "spearman", 0.0), 6)


@R.add("correlation_simple", f"""WITH {_WIDE}, p AS ({_pairs(_NUM)}) SELECT field_a, field_b, round_even(r, 3) AS correlation, CASE WHEN abs(r) >= 0.8 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'medium'
 WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very_weak' END AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM p""")
def _(d):
    return K.correlation_simple(_wide(d), _NUM)


@R.add("correlation_report", f"WITH {_WIDE}, p AS ({_pairs(_NUM)}) SELECT field_a, field_b, round(r, 6) AS correlation FROM p WHERE abs(r) > 0.7")
def _(d):
    return rounded(K.correlation_report(_wide(d), _NUM), 6)


@R.add("scatter_sample", """SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem_dirty WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
 ORDER BY md5(concat_ws('-', 42, l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 5000""")
def _(d):
    return K.scatter_sample(d.lineitem_dirty, "l_quantity", "l_extendedprice", key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@R.add("scatter_info", """SELECT 'ok' AS status, round(corr(l_quantity, l_extendedprice), 6) AS correlation, count(*) AS sample_size, least(count(*), 5000) AS shown,
 count(*) > 5000 AS is_sampled FROM lineitem_dirty WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def _(d):
    return rounded(K.scatter_info(d.lineitem_dirty, "l_quantity", "l_extendedprice"), 6)


# ---- report --------------------------------------------------------------------------------------------
_RN, _RT = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus"]


def _unpivot(section: str, subject: str, metrics: list[str], src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {subject} AS subject, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS \"value\" FROM {src}" for m in metrics)


_REPORT = f"""v AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate FROM orders_keys),
 num AS ({each(_RN, '''SELECT '{c}' AS "column", avg({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, stddev_samp({c}) AS std, min({c}) AS "min", max({c}) AS "max",
 1 - count({c}) / count(*) AS missing_rate FROM v''')}),
 o0 AS ({outliers_each(_RN, 'v')}), o AS (SELECT *, outlier_count / valid_count AS outlier_ratio FROM o0),
 p AS ({_pairs(_RN, 'v')}), c AS (SELECT field_a || '|' || field_b AS k, r AS correlation FROM p WHERE abs(r) > 0.7),
 tv AS (SELECT coalesce(o_orderstatus, '<缺失>') AS s, count(*) AS "count", count(*) / (SELECT count(*) FROM v) AS ratio FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
 cat AS (SELECT (SELECT count(DISTINCT o_orderstatus) FROM v) AS unique_count, sum(ratio) AS top5_ratio, max(ratio) AS top1_ratio, (SELECT 1 - count(o_orderstatus) / count(*) FROM v) AS missing_rate FROM tv),
 ov AS (SELECT count(*) AS row_count, 5 AS column_count, 3 AS numeric_column_count, 1 AS categorical_column_count, 1 AS date_column_count FROM v)"""


def _report_view(d):
    return d.orders_keys.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")


@R.add("eda_report", f"""WITH {_REPORT}, r AS ({_unpivot('overview', "'table'", ['row_count', 'column_count', 'numeric_column_count', 'categorical_column_count', 'date_column_count'], 'ov')}
 UNION ALL {_unpivot('numeric', '"column"', ['mean', 'median', 'std', 'min', 'max', 'missing_rate'], 'num')}
 UNION ALL {_unpivot('outliers', '"column"', ['q1', 'q3', 'iqr', 'lower_bound', 'upper_bound', 'outlier_count', 'outlier_ratio'], 'o')}
 UNION ALL {_unpivot('correlation', 'k', ['correlation'], 'c')}
 UNION ALL {_unpivot('categorical', "'o_orderstatus'", ['unique_count', 'top5_ratio', 'top1_ratio', 'missing_rate'], 'cat')}
 UNION ALL {_unpivot('top_value', "'o_orderstatus|' || s", ['count', 'ratio'], 'tv')}) SELECT section, subject, metric, round("value", 4) AS "value" FROM r""")
def _(d):
    return rounded(E.eda_report(_report_view(d)))


def _flag_view(d):
    df = d.lineitem_dirty.select("l_quantity", "l_extendedprice", "l_tax_sparse", "l_returnflag", "const_col")
    return df.withColumns({"price2": F.col("l_extendedprice") * 2, "spike": F.when(F.col("l_quantity") > 46, 1000.0).otherwise(F.col("l_quantity") / 10)})


_FN = ["l_quantity", "l_extendedprice", "l_tax_sparse", "price2", "spike"]
_FV = """v AS (SELECT l_quantity, l_extendedprice, l_tax_sparse, l_returnflag, const_col, l_extendedprice * 2 AS price2,
 CASE WHEN l_quantity > 46 THEN 1000.0 ELSE l_quantity / 10 END AS spike FROM lineitem_dirty)"""


@R.add("eda_flags", f"""WITH {_FV}, m AS ({each(_FN + ['l_returnflag', 'const_col'], '''SELECT '{c}' AS s, 1 - count({c}) / count(*) AS a FROM v''')}),
 o0 AS ({outliers_each(_FN, 'v')}), o AS (SELECT "column" AS s, outlier_count / valid_count AS a FROM o0), p AS ({_pairs(_FN, 'v')}),
 t AS ({each(['l_returnflag', 'const_col'], '''SELECT * FROM (SELECT '{c}' AS s, coalesce({c}, '<缺失>') AS v, count(*) / (SELECT count(*) FROM v) AS a FROM v GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 1)''')}),
 f AS (SELECT 'warning' AS "group", 'high_missing_rate' AS flag, 'medium' AS severity, s AS subject, a AS amount FROM m WHERE a > 0.3
 UNION ALL SELECT 'insight', 'high_concentration', NULL, s || '|' || v, a FROM t WHERE a > 0.6 UNION ALL SELECT 'warning', 'high_concentration', 'medium', s, a FROM t WHERE a > 0.6
 UNION ALL SELECT 'insight', 'high_outlier_ratio', NULL, s, a FROM o WHERE a > 0.05 UNION ALL SELECT 'warning', 'high_outlier_ratio', 'medium', s, a FROM o WHERE a > 0.05
 UNION ALL SELECT 'insight', 'strong_correlation', NULL, field_a || '|' || field_b, r FROM p WHERE abs(r) > 0.8 UNION ALL SELECT 'warning', 'strong_correlation', 'low', field_a || '|' || field_b, r FROM p WHERE abs(r) > 0.8)
 SELECT "group", flag, severity, subject, round(amount, 6) AS amount FROM f""")
def _(d):
    return rounded(E.eda_flags(_flag_view(d)), 6)


__all__ = ["C", "R", "read_span"]
