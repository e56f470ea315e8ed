"""Tags for a table of business questions: column expressions over the text, no UDF.

Keyword lists are configuration with the defaults below.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import columns as C
from tallyframe.functions.parsing import parse_datetime
from tallyframe.operators.query import time_bounds
from tallyframe.session import cut_lineage

# ---- fixed values: keywords and patterns of the questions ---------------------------------------------
CONTRIBUTION = ("贡献", "占比", "大部分", "构成", "占了多少")
COMPARISON = ("同比", "环比", "较上月", "较上周", "比去年", "对比", "比较", "相比")
COMPARISON_PATTERN = r".+和.+哪个.*(更|高|低|多|少)"
TREND = ("趋势", "走势", "每天", "每日", "逐日", "按日", "按月", "变化怎么样")
RANKING = ("最高", "最多", "最大", "最低", "最少", "最小", "Top", "top", "排名", "前")
SUMMARY = ("整体", "表现", "概况", "总结", "怎么样", "情况")
DESCENDING = ("最高", "最多", "最大", "Top", "top", "排名", "前")
ASCENDING = ("最低", "最少", "最小")
TIME_PATTERNS = (r"最近\s*\d+\s*天", r"最近\s*\d+\s*周", r"最近\s*\d+\s*个月", r"\d{4}\s*年\s*\d{1,2}\s*月", r"\d{1,2}\s*月")
TIME_WORDS = ("今天", "昨天", "本周", "上周", "本月", "上月", "本季度", "今年", "最近")
TOP_N_PATTERNS = (r"(?:Top|top)\s*(\d+)", r"前\s*(\d+)", r"(?:最高|最多|最大|最低|最少|最小)的?\s*(\d+)\s*个", r"哪\s*(\d+)\s*个")
RECENT_MONTHS_PATTERN = r"近\s*(\d+)\s*个?月"
LIMIT_PATTERN = r"(?i)(?:top\s*|前|(?:最高|最多)的?\s*前?|排名\s*前)\s*(\d+|[一二三四五六七八九十两]+)\s*个?"
GROWTH_RANKING = ("增长最快", "增长最高")
DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
DIMENSION_WORDS = {
    "region": ("区域", "地区", "省份", "城市", "大区", "华东", "华南", "华北", "华中", "西南", "西北"),
    "product": ("产品", "商品", "SKU", "sku", "品类", "类别"),
    "person": ("销售员", "员工", "业务员", "顾问", "人员"),
    "date": ("日期", "时间", "每天", "每日", "按天", "按月", "月份"),
}
CLAUSE_METRIC = r"成交金额|销售额|订单数|客户数|客单价|利润|收入|增长率|增长"
CLAUSE_INTENT = r"最高|最多|最少|排名|分析|趋势|对比|哪些|哪个|谁|是多少|表现"
CONNECTORS = ("同时", "另外", "以及", "并且", "还有")
TARGET_DIMENSIONS = r"小组|销售人员|销售员|员工|工号|区域|地区|产品|客户|门店|渠道|部门|团队"
# ---- end of fixed values -------------------------------------------------------------------------------

VALUE_LIST_LIMIT = 2_000  # up to here a column's values travel as a literal list, beyond it through a join


def has_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_hit(text: Column, patterns, group: int) -> Column:
    """Group of the first pattern that matches, else NULL."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, group)) for p in patterns])


def intent_of(text: Column) -> Column:
    return (F.when(has_any(text, CONTRIBUTION), "contribution")
            .when(has_any(text, COMPARISON) | text.rlike(COMPARISON_PATTERN), "comparison")
            .when(has_any(text, TREND), "trend").when(has_any(text, RANKING), "ranking")
            .when(has_any(text, SUMMARY), "summary").otherwise("unknown"))


def time_range_of(text: Column) -> Column:
    found = F.regexp_replace(first_hit(text, TIME_PATTERNS, 0), r"\s+", "")
    words = F.coalesce(*[F.when(text.contains(w), w) for w in TIME_WORDS])
    return F.coalesce(found, words, F.lit(""))


def sort_of(text: Column) -> Column:
    return F.when(has_any(text, ASCENDING), "asc").when(has_any(text, DESCENDING), "desc").otherwise("")


def top_n_of(text: Column) -> Column:
    """Stated number, 1 when only a sort is asked for, NULL otherwise."""
    return F.coalesce(first_hit(text, TOP_N_PATTERNS, 1).try_cast("int"), F.when(sort_of(text) != "", F.lit(1)))


def comparison_of(text: Column) -> Column:
    return (F.when(has_any(text, ("同比", "比去年")), "yoy").when(has_any(text, ("环比", "较上月", "较上周")), "mom")
            .when(has_any(text, ("增长", "下降", "变化")), "change").otherwise(""))


def number_of(text: Column) -> Column:
    """Digits or a Chinese number up to 99."""
    digit = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    tens, ones = F.substring_index(text, "十", 1), F.regexp_replace(text, "^[^十]*十", "")
    compound = F.coalesce(F.try_element_at(digit, tens), F.lit(1)) * 10 + F.coalesce(F.try_element_at(digit, ones), F.lit(0))
    return F.coalesce(text.try_cast("int"), F.try_element_at(digit, text), F.when(text.contains("十"), compound))


def limit_of(text: Column) -> Column:
    return F.when(text.rlike(LIMIT_PATTERN), number_of(F.regexp_extract(text, LIMIT_PATTERN, 1)))


def question_tags(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds intent, time_range, sort, top_n, comparison, recent_months, query_limit, query_intent."""
    text = F.trim(F.coalesce(C.quoted(question), F.lit("")))
    low = F.lower(text)
    months = F.when(low.rlike(RECENT_MONTHS_PATTERN), F.regexp_extract(low, RECENT_MONTHS_PATTERN, 1)).try_cast("int")
    return df.withColumns({
        "intent": intent_of(text), "time_range": time_range_of(text), "sort": sort_of(text), "top_n": top_n_of(text),
        "comparison": comparison_of(text), "recent_months": months, "query_limit": limit_of(low),
        "query_intent": F.when(has_any(low, GROWTH_RANKING), "growth_ranking").otherwise("ranking"),
    })


# ---- metric and dimension ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Metric:
    name: str
    aliases: tuple[str, ...] = ()
    kpi_name: str = ""
    source_field: str = ""
    source: str = "dictionary"
    aggregation: str = "sum"


@dataclass(frozen=True)
class Context:
    """What questions may refer to."""

    metrics: tuple[Metric, ...] = ()
    field_types: dict[str, str] = field(default_factory=dict)  # column -> region, product, person, date
    columns: tuple[str, ...] = ()


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def longest_contained(text: Column, candidates: list[tuple[str, str, str]]) -> Column:
    """struct(candidate, target, source) of the longest candidate inside the text; the earlier one on ties.

    The list is configuration, so it travels as a literal and no join is needed.
    """
    shape = "struct<len:int,first:int,key:string,candidate:string,target:string,source:string>"
    if not candidates:
        return F.lit(None).cast(shape)
    plain = squeezed(text)
    items = F.array(*[F.struct(
        F.lit(len(c)).alias("len"), F.lit(-i).alias("first"), F.lit("".join(c.lower().split())).alias("key"),
        F.lit(c).alias("candidate"), F.lit(t).alias("target"), F.lit(s).alias("source")) for i, (c, t, s) in enumerate(candidates)])
    return F.array_max(F.filter(items, lambda x: plain.contains(x["key"])))


def _metric_candidates(context: Context) -> list[tuple[str, str, str]]:
    out = []
    for m in context.metrics:
        names = (m.name, m.kpi_name, *m.aliases) if m.source == "dictionary" else (m.name, m.source_field)
        out += [(n.strip(), m.name, m.source) for n in names if n.strip()]
    return out


def question_metric(df: DataFrame, context: Context, question: str = "question") -> DataFrame:
    """Adds metric, metric_alias, aggregation, dimension, dimension_by ('' where nothing is found)."""
    text = F.coalesce(C.quoted(question), F.lit(""))
    metric = longest_contained(text, _metric_candidates(context))
    mapped = [(c, c, "field_name") for c, t in context.field_types.items() if t in DIMENSION_WORDS]
    by_field = longest_contained(text, mapped)
    by_column = longest_contained(text, [(c, c, "dataset_column") for c in context.columns])
    owner = {t: c for c, t in reversed(list(context.field_types.items()))}
    fallback = F.coalesce(*[F.when(has_any(text, words), owner.get(kind, kind)) for kind, words in DIMENSION_WORDS.items()])
    found = F.coalesce(by_field, by_column)
    empty = F.lit("")
    way = F.coalesce(*[F.when(metric["target"] == m.name, m.aggregation) for m in context.metrics], empty)
    return df.withColumns({
        "metric": F.coalesce(metric["target"], empty), "metric_alias": F.coalesce(metric["candidate"], empty), "aggregation": way,
        "dimension": F.coalesce(found["target"], fallback, empty),
        "dimension_by": F.coalesce(found["source"], F.when(fallback.isNotNull(), "field_type"), empty),
    })


# ---- from tags to a query --------------------------------------------------------------------------------

# Time words of questions and the time-range codes of query.time_bounds.
TIME_CODES = {"今天": "today", "昨天": "yesterday", "本周": "this_week", "上周": "last_week", "本月": "this_month", "上月": "last_month"}


def time_code(time_range: Column) -> Column:
    """The code that query.time_bounds knows for a time_range tag; '' for a tag it has no range for."""
    days = F.regexp_extract(time_range, r"^最近(\d+)天$", 1)
    named = [F.when(time_range == word, code) for word, code in TIME_CODES.items()]
    return F.coalesce(F.when(days != "", F.concat(F.lit("last_"), days, F.lit("_days"))), *named, F.lit(""))


def code_days(code: Column, as_of: date) -> tuple[Column, Column]:
    """First and last day of each row's code, as query.time_bounds gives them for one; NULL for ''."""
    given = F.regexp_extract(code, r"^last_(\d+)_days$", 1).try_cast("int")
    first = F.when(given.isNotNull(), F.date_sub(F.lit(as_of), F.greatest(given - 1, F.lit(0))))
    last = F.when(given.isNotNull(), F.lit(as_of))
    for name in TIME_CODES.values():
        low, high = time_bounds(name, as_of)
        first, last = first.when(code == name, F.lit(low)), last.when(code == name, F.lit(high))
    return first, last


def question_totals(tagged: DataFrame, data: DataFrame, date_field: str, measures: dict[str, str], as_of: date,
                    key: str = "question_id") -> DataFrame:
    """key, metric, time_code, first_day, last_day, answer: the tagged questions run against the data.

    measures: metric -> column. Questions without a known range, or about another metric, are left out. The data come down to
    one row a day first, and meet the days of each range by equality.
    """
    first, last = code_days(F.col("time_code"), as_of)
    # the tags are computed once, before the filters below can reach into them
    tags = cut_lineage(tagged.select(key, "metric", "aggregation", "time_range"))
    asked = (tags.withColumn("time_code", time_code(F.col("time_range"))).filter(F.col("metric").isin(list(measures)))
             .withColumns({"first_day": first, "last_day": last}).filter("first_day IS NOT NULL")
             .select(key, "metric", "aggregation", "time_code", "first_day", "last_day"))
    day = parse_datetime(data, date_field).cast("date")
    sums = [F.coalesce(F.sum(C.as_double(data, c)), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(measures.values())]
    counts = [F.count(C.quoted(c)).cast("double").alias(f"n{i}") for i, c in enumerate(measures.values())]
    daily = data.filter(day.isNotNull()).groupBy(day.alias("day")).agg(*sums, *counts)
    days = asked.select("*", F.explode(F.sequence("first_day", "last_day")).alias("day")).join(daily, "day", "left")
    value = F.coalesce(*[F.when(F.col("metric") == m, F.when(F.col("aggregation") == "count", F.col(f"n{i}")).otherwise(F.col(f"s{i}")))
                         for i, m in enumerate(measures)], F.lit(0.0))
    return days.groupBy(key, "metric", "time_code", "first_day", "last_day").agg(F.sum(value).alias("answer"))


# ---- filters -------------------------------------------------------------------------------------------

def question_filters(questions: DataFrame, data: DataFrame, columns: list[str], key: str = "question_id",
                     question: str = "question", list_limit: int | None = None) -> DataFrame:
    """key, field, value: the longest value (at least 2 characters) of each column contained in the question."""
    list_limit = VALUE_LIST_LIMIT if list_limit is None else list_limit
    parts = []
    for c in columns:
        values = data.select(C.present(data, c).cast("string").alias("value")).filter(
            F.char_length("value") >= 2).distinct()
        few = [r["value"] for r in values.limit(list_limit + 1).collect()]
        if len(few) <= list_limit:
            parts.append(_by_list(questions, sorted(few), c, key, question))
        else:
            parts.append(_by_join(questions, values, c, key, question))
    return reduce(DataFrame.unionByName, parts)


def _by_list(questions: DataFrame, values: list[str], column: str, key: str, question: str) -> DataFrame:
    if not values:
        return questions.limit(0).select(C.quoted(key), F.lit(column).alias("field"), F.lit("").alias("value"))
    text = C.quoted(question)
    inside = F.filter(F.array(*[F.lit(v) for v in values]), lambda v: text.contains(v))
    longest = F.array_max(F.transform(inside, lambda v: F.struct(F.char_length(v).alias("n"), v.alias("v"))))["v"]
    return questions.select(C.quoted(key), F.lit(column).alias("field"), longest.alias("value")).filter("value IS NOT NULL")


def _by_join(questions: DataFrame, values: DataFrame, column: str, key: str, question: str) -> DataFrame:
    """Any number of values: the question's pieces of each occurring length meet the values by equality."""
    lengths = values.agg(F.collect_set(F.char_length("value"))).scalar()  # one entry per distinct length
    text = C.quoted(question)
    pieces = questions.select(C.quoted(key), text.alias("t"), F.explode(lengths).alias("n")).filter(
        F.col("n") <= F.char_length("t")).select(
        key, F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.char_length("t") - F.col("n") + 1), lambda i: F.substring(F.col("t"), i, F.col("n"))))).alias("value"))
    hits = pieces.join(values, "value")
    best = F.max(F.struct(F.char_length("value").alias("n"), F.col("value").alias("v")))
    return hits.groupBy(C.quoted(key)).agg(best.alias("b")).select(key, F.lit(column).alias("field"), F.col("b.v").alias("value"))


# ---- confidence and multi-question ---------------------------------------------------------------------

def question_confidence(tagged: DataFrame, filters: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """Adds confidence and warnings to a frame that went through question_tags and question_metric."""
    if filters is not None:
        hit = filters.select(C.quoted(key).alias("_k")).distinct().withColumn("_f", F.lit(True))
        tagged = tagged.join(hit, C.quoted(key) == F.col("_k"), "left").drop("_k")
    else:
        tagged = tagged.withColumn("_f", F.lit(None).cast("boolean"))

    def points(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    named, placed, known = F.col("metric") != "", F.col("dimension") != "", F.col("intent") != "unknown"
    total = (points(named, 35) + points(placed, 25) + points(known, 20)
             + points((F.col("time_range") != "") | (F.col("sort") != ""), 10) + points(F.coalesce("_f", F.lit(False)), 10))
    needs = F.col("intent").isin("ranking", "comparison", "contribution", "trend")
    warnings = F.concat_ws(";", F.when(~named, "no_metric"), F.when(~known, "no_intent"), F.when(~placed & needs, "no_dimension"))
    return tagged.withColumns({"confidence": total / 100.0, "warnings": warnings}).drop("_f")


def is_clause(text: Column) -> Column:
    return text.rlike(CLAUSE_METRIC) & text.rlike(CLAUSE_INTENT)


def _several(parts: Column) -> Column:
    kept = F.filter(parts, lambda p: F.trim(p) != "")
    return (F.size(kept) >= 2) & F.forall(kept, is_clause)


def _two(text: Column, separator: str) -> Column:
    parts = F.split(text, separator, 2)
    return (F.size(parts) == 2) & F.forall(parts, is_clause)


def question_multi(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds is_multi: more than one analysis question in one text."""
    text = F.trim(F.coalesce(C.quoted(question), F.lit("")))

    def targets(pattern: str) -> Column:
        return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))) >= 2

    each = text.contains("分别") & (targets(TARGET_DIMENSIONS) | targets(CLAUSE_METRIC))
    tests = [_several(F.split(text, "[?？]+")), _several(F.split(text, "[;；]+")), *[_two(text, c) for c in CONNECTORS],
             _two(text, r"[，,]\s*又"), each]
    return df.withColumn("is_multi", F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)))

