"""Question tagging over questions built from the tables."""

from __future__ import annotations

from datetime import date

from tallyframe.catalog.base import Registry, rounded
from tallyframe.operators import questions as Q
from tallyframe.operators.questions import Context, Metric

R = Registry()
CONTEXT = Context(
    metrics=(Metric("销售额", ("成交金额", "Sales Amount", "turnover"), "revenue"), Metric("客户数", ("人数",), aggregation="count"), Metric("订单数", aggregation="count"),
             Metric("利润总额", source_field="利润", source="kpi")),
    field_types={"区域": "region", "产品": "product"}, columns=("小组", "hello"))


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def q(text: str) -> str:
    return text.replace("\\\\", "\\")


def first(patterns, group: int) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN regexp_extract(q, '{p}', {group}) END" for p in patterns) + ")"


INTENT = (f"CASE WHEN {any_of(Q.CONTRIBUTION)} THEN 'contribution' WHEN {any_of(Q.COMPARISON)} OR regexp_matches(q, '{Q.COMPARISON_PATTERN}') THEN 'comparison' "
          f"WHEN {any_of(Q.TREND)} THEN 'trend' WHEN {any_of(Q.RANKING)} THEN 'ranking' WHEN {any_of(Q.SUMMARY)} THEN 'summary' ELSE 'unknown' END")
SORT = f"CASE WHEN {any_of(Q.ASCENDING)} THEN 'asc' WHEN {any_of(Q.DESCENDING)} THEN 'desc' ELSE '' END"
RANGE = (f"coalesce(regexp_replace({first(Q.TIME_PATTERNS, 0)}, '\\s+', '', 'g'), "
         + "CASE " + " ".join(f"WHEN contains(q, '{w}') THEN '{w}'" for w in Q.TIME_WORDS) + " END, '')")
NUMBER = ("CASE x WHEN '' THEN NULL WHEN '十二' THEN 12 WHEN '二十三' THEN 23 WHEN '十' THEN 10 ELSE TRY_CAST(x AS INTEGER) END")
TAGS = f"""t AS (SELECT question_id, trim(question) AS q, regexp_extract(lower(trim(question)), '{Q.LIMIT_PATTERN}', 1) AS x FROM questions),
 g AS (SELECT question_id, q, {INTENT} AS intent, {RANGE} AS time_range, {SORT} AS sort,
 coalesce(TRY_CAST({first(Q.TOP_N_PATTERNS, 1)} AS INTEGER), CASE WHEN {SORT} <> '' THEN 1 END) AS top_n,
 CASE WHEN {any_of(('同比', '比去年'))} THEN 'yoy' WHEN {any_of(('环比', '较上月', '较上周'))} THEN 'mom' WHEN {any_of(('增长', '下降', '变化'))} THEN 'change' ELSE '' END AS comparison,
 TRY_CAST(nullif(regexp_extract(lower(q), '{Q.RECENT_MONTHS_PATTERN}', 1), '') AS INTEGER) AS recent_months, {NUMBER} AS query_limit,
 CASE WHEN {any_of(Q.GROWTH_RANKING)} THEN 'growth_ranking' ELSE 'ranking' END AS query_intent FROM t)"""


@R.add("question_tags", f"WITH {TAGS} SELECT * EXCLUDE (q) FROM g")
def _(d):
    return Q.question_tags(d.questions).drop("question")


def longest(candidates) -> str:
    rows = ", ".join(f"({i}, '{''.join(c.lower().split())}', '{c}', '{t}', '{s}')" for i, (c, t, s) in enumerate(candidates))
    return f"""SELECT question_id, candidate, target, source FROM (SELECT question_id, candidate, target, source, row_number() OVER (PARTITION BY question_id
 ORDER BY length(candidate) DESC, i) AS rn FROM questions, (VALUES {rows}) AS a(i, k, candidate, target, source) WHERE contains(regexp_replace(lower(question), '\\s+', '', 'g'), k)) WHERE rn = 1"""


_METRICS = [("销售额", "销售额", "d"), ("revenue", "销售额", "d"), ("成交金额", "销售额", "d"), ("Sales Amount", "销售额", "d"), ("turnover", "销售额", "d"),
            ("客户数", "客户数", "d"), ("人数", "客户数", "d"), ("订单数", "订单数", "d"), ("利润总额", "利润总额", "k"), ("利润", "利润总额", "k")]
_FALLBACK = "CASE " + " ".join(
    f"WHEN {any_of(w)} THEN '{ {'region': '区域', 'product': '产品'}.get(k, k) }'" for k, w in Q.DIMENSION_WORDS.items()) + " END"
METRIC = f"""m AS ({longest(_METRICS)}), f AS ({longest([('区域', '区域', 'field_name'), ('产品', '产品', 'field_name')])}),
 c AS ({longest([('小组', '小组', 'dataset_column'), ('hello', 'hello', 'dataset_column')])}),
 z AS (SELECT question_id, question AS q FROM questions), w AS (SELECT z.question_id, q, coalesce(m.target, '') AS metric, coalesce(m.candidate, '') AS metric_alias,
 CASE WHEN m.target IS NULL THEN '' WHEN m.target IN ('客户数', '订单数') THEN 'count' ELSE 'sum' END AS aggregation,
 coalesce(f.target, c.target, {_FALLBACK}, '') AS dimension,
 coalesce(f.source, c.source, CASE WHEN {_FALLBACK} IS NOT NULL THEN 'field_type' END, '') AS dimension_by
 FROM z LEFT JOIN m ON z.question_id = m.question_id LEFT JOIN f ON z.question_id = f.question_id LEFT JOIN c ON z.question_id = c.question_id)"""


@R.add("question_metric", f"WITH {METRIC} SELECT * EXCLUDE (q) FROM w")
def _(d):
    return Q.question_metric(d.questions, CONTEXT).drop("question")


_AS_OF = date(1998, 7, 15)  # a Wednesday within the orders


@R.add("question_totals", f"""WITH {TAGS}, {METRIC}, r AS (SELECT g.question_id, metric, aggregation, CASE time_range WHEN '今天' THEN 'today' WHEN '昨天' THEN 'yesterday'
 WHEN '本周' THEN 'this_week' WHEN '上周' THEN 'last_week' WHEN '本月' THEN 'this_month' WHEN '上月' THEN 'last_month'
 ELSE 'last_' || regexp_extract(time_range, '^最近(\\d+)天$', 1) || '_days' END AS time_code FROM g JOIN w ON g.question_id = w.question_id
 WHERE metric IN ('销售额', '订单数') AND (time_range IN ('今天', '昨天', '本周', '上周', '本月', '上月') OR regexp_matches(time_range, '^最近\\d+天$'))),
 b AS (SELECT *, CASE time_code WHEN 'today' THEN DATE '1998-07-15' WHEN 'yesterday' THEN DATE '1998-07-14' WHEN 'this_week' THEN DATE '1998-07-13'
 WHEN 'last_week' THEN DATE '1998-07-06' WHEN 'this_month' THEN DATE '1998-07-01' WHEN 'last_month' THEN DATE '1998-06-01'
 ELSE DATE '1998-07-15' - CAST(regexp_extract(time_code, '\\d+') AS INTEGER) + 1 END AS first_day, CASE time_code WHEN 'yesterday' THEN DATE '1998-07-14'
 WHEN 'last_week' THEN DATE '1998-07-12' WHEN 'last_month' THEN DATE '1998-06-30' ELSE DATE '1998-07-15' END AS last_day FROM r)
 SELECT question_id, metric, time_code, first_day, last_day, CAST(round(coalesce(sum(CASE WHEN aggregation = 'count' THEN n ELSE s END), 0), 2) AS DOUBLE) AS answer FROM b LEFT JOIN
 (SELECT CAST(o_orderdate AS DATE) AS d, count(o_orderkey) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON d BETWEEN first_day AND last_day GROUP BY ALL""")
def _(d):
    tagged = Q.question_metric(Q.question_tags(d.questions), CONTEXT)
    return rounded(Q.question_totals(tagged, d.orders, "o_orderdate", {"销售额": "o_totalprice", "订单数": "o_orderkey"}, _AS_OF), 2)


_VALUES = "v AS (SELECT 'nation' AS field, n_name AS val FROM nation UNION SELECT 'segment', c_mktsegment FROM customer)"
FILTERS = f"""{_VALUES}, k AS (SELECT question_id, field, val AS "value" FROM (SELECT question_id, field, val, row_number() OVER (PARTITION BY question_id, field ORDER BY length(val) DESC, val DESC) AS rn
 FROM questions, v WHERE contains(question, val)) WHERE rn = 1)"""


def _dims(d):
    from pyspark.sql import functions as F

    return d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


@R.add("question_filters", f"WITH {FILTERS} SELECT * FROM k")
def _(d):
    return Q.question_filters(d.questions, _dims(d), ["nation", "segment"])


@R.add("question_filters_join", f"WITH {FILTERS} SELECT * FROM k")
def _(d):
    return Q.question_filters(d.questions, _dims(d), ["nation", "segment"], list_limit=0)


@R.add("question_confidence", f"""WITH {TAGS}, {METRIC}, {FILTERS} SELECT g.question_id, (CASE WHEN metric <> '' THEN 35 ELSE 0 END + CASE WHEN dimension <> '' THEN 25 ELSE 0 END
 + CASE WHEN intent <> 'unknown' THEN 20 ELSE 0 END + CASE WHEN time_range <> '' OR sort <> '' THEN 10 ELSE 0 END
 + CASE WHEN g.question_id IN (SELECT question_id FROM k) THEN 10 ELSE 0 END) / CAST(100 AS DOUBLE) AS confidence,
 concat_ws(';', CASE WHEN metric = '' THEN 'no_metric' END, CASE WHEN intent = 'unknown' THEN 'no_intent' END,
 CASE WHEN dimension = '' AND intent IN ('ranking', 'comparison', 'contribution', 'trend') THEN 'no_dimension' END) AS warnings
 FROM g JOIN w ON g.question_id = w.question_id""")
def _(d):
    tagged = Q.question_metric(Q.question_tags(d.questions), CONTEXT)
    filters = Q.question_filters(d.questions, _dims(d), ["nation", "segment"])
    return Q.question_confidence(tagged, filters).select("question_id", "confidence", "warnings")


def clause(x: str) -> str:
    return f"(regexp_matches({x}, '{Q.CLAUSE_METRIC}') AND regexp_matches({x}, '{Q.CLAUSE_INTENT}'))"


def _several(pattern: str) -> str:
    parts = f"list_filter(regexp_split_to_array(q, '{pattern}'), lambda p: trim(p) <> '')"
    return f"(len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT {clause('p')})) = 0)"


def _two(word: str) -> str:
    return f"(contains(q, '{word}') AND {clause(f'''split_part(q, '{word}', 1)''')} AND {clause(f'''substr(q, strpos(q, '{word}') + {len(word)})''')})"


def _targets(pattern: str) -> str:
    return f"len(list_distinct(regexp_extract_all(q, '({pattern})'))) >= 2"


@R.add("question_multi", f"""WITH t AS (SELECT question_id, trim(question) AS q FROM questions) SELECT question_id, ({_several('[?？]+')} OR {_several('[;；]+')} OR {' OR '.join(_two(c) for c in Q.CONNECTORS)}
 OR {_two('，又')} OR (contains(q, '分别') AND ({_targets(Q.TARGET_DIMENSIONS)} OR {_targets(Q.CLAUSE_METRIC)}))) AS is_multi FROM t""")
def _(d):
    return Q.question_multi(d.questions).drop("question")
