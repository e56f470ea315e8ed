"""Rules, edge cases (empty, all missing, single row) and errors."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.parsing import id_text, parse_datetime
from tallyframe.functions import names as N
from tallyframe.operators import business as B, categories as G, cleaning as K, combine as A, correlation as R, kpi, numeric, query as Q
from tallyframe.operators import joins as J, outliers as O, profiling as P, quality, report, roles, timeline as L
from tallyframe.operators.questions import question_multi, question_tags
from tallyframe.plans.cleaning_plan import DuplicateChoice, MissingChoice, Step, apply_step, audited_plan, last_per_column, missing_steps, rows_left_of_groups
from tallyframe.sources.readers import read_csv, read_events
from tallyframe.sources.sinks import redact, write_csv


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "a int, v double, s string, d timestamp_ntz")


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, 2.5, "x", dt.datetime(2026, 4, 5, 9))], "a int, v double, s string, d timestamp_ntz")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([(None, None, None, None)] * 3, "a int, v double, s string, d timestamp_ntz")


@pytest.mark.parametrize("name", ["empty", "one", "nothing"])
def test_edges(name, request):
    df = request.getfixturevalue(name)
    n = df.count()
    assert P.field_profile(df).count() == 4
    assert P.basic_info(df).first()["row_count"] == n
    assert quality.missing_summary(df).count() == 4
    assert quality.duplicate_summary(df).first()["extra_rows"] == (2 if name == "nothing" else 0)
    assert quality.quality_score_v2(df, [], [], ["v"]).first()["score"] >= 0
    assert O.outlier_summary(df, ["a", "v"]).count() == 2
    assert numeric.numeric_distribution(df, ["v"]).first()["status"] in ("insufficient", "constant")
    assert numeric.histogram_bins(df, ["v"]).first()["bin_count"] == 10
    assert G.composition_summary(df, "s").first()["status"] == ("constant" if name == "one" else "no_valid_data")
    assert G.category_topn_other(df, "s", 3).count() == (1 if name == "one" else 0)
    assert G.category_summary(df, ["s"]).first()["top_count"] == (1 if name == "one" else 0)
    assert L.time_summary(df, "d").first()["status"] == ("single_date" if name == "one" else "no_valid_dates")
    assert L.time_distribution(df, "d").count() == (1 if name == "one" else 0)
    assert R.correlation_pairs(df, ["a", "v"]).count() == 0
    assert K.fill_median(df, "v").count() == n and K.fill_mode(df, "s").count() == n
    assert K.equal_width_bins(df, "v").count() == n
    assert Q.aggregate(df, "v", "sum").first()[0] == (2.5 if name == "one" else 0)
    assert report.eda_flags(df).count() >= 0
    assert roles.field_roles(df).count() == 4
    assert B.dimension_share(df, "s", "orders", B.Fields()).count() == (0 if name == "empty" else 1)


def test_parse_datetime(spark):
    texts = ["2026-04-01", "2026-04-01 08:30:00", "2026/4/1", "20260401", "2026年4月1日", "n/a", "", None, "2026-13-01", "2026-04-01T08:30:00+08:00"]
    df = spark.createDataFrame([(t, 2026) for t in texts], "t string, y int")
    got = [r[0] for r in df.select(parse_datetime(df, "t")).collect()]
    d, m = dt.datetime(2026, 4, 1), dt.datetime(2026, 4, 1, 8, 30)
    assert got == [d, m, d, d, d, None, None, None, None, m]
    assert df.filter(parse_datetime(df, "y").isNotNull()).count() == 0  # a number is never an epoch


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("12.5",), (" 7 ",), ("12d",), ("1e3",), ("",), ("abc",), (None,), ("-.5",)], "t string")
    from tallyframe.functions.columns import as_double

    assert [r[0] for r in df.select(as_double(df, "t")).collect()] == [12.5, 7.0, None, 1000.0, None, None, None, -0.5]
    ids = spark.createDataFrame([(12.0,), (1.5,), (None,), (float("inf"),), (1e15,)], "x double")
    assert [r[0] for r in ids.select(id_text(ids, "x")).collect()] == ["12", "1.5", "", "", "1000000000000000"]


def test_time_parts(spark):
    assert [N.time_part_of(n) for n in ("year", "订单月份", "fiscal_quarter", "week_day", "yearly", "季度")] == [
        "year", "month", "quarter", "weekday", None, "quarter"]
    df = spark.createDataFrame([("Q1", "周一", 2026, 13), ("2026-Q4", "Sun", 2025, 14)], "quarter string, `星期` string, year int, month int")
    got = {r["column"]: r["is_derived_time"] for r in roles.derived_time_columns(df).collect()}
    assert got == {"quarter": True, "星期": True, "year": True, "month": False}
    r = {x["column"]: x for x in roles.field_roles(df, confirmed={"year": "date"}).collect()}
    assert r["year"]["role"] == "derived_time" and r["year"]["date_confirmed_but_partial"]


def test_period_shift_and_growth(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 31), 100.0), (dt.datetime(2026, 3, 1), 50.0)], "d timestamp_ntz, v double")
    f = B.Fields(date="d", amount="v")
    r = {x["metric"]: x for x in B.period_dashboard(df, "d", "month", f).collect()}
    assert r["amount"]["current_period"] == "2026-03" and r["amount"]["previous"] is None and r["amount"]["mom"] is None
    with pytest.raises(ValueError):
        B.growth_ranking(df.limit(1), "v", "amount", f)
    with pytest.raises(ValueError):
        B.ranking_query(df, B.Ranking("v", "amount"), f)


def test_quantity_names():
    assert [N.is_additive_quantity(n) for n in ("item_quantity", "orderCount", "conversion_rate", "客户数", "quantity_id", "year")] == [
        True, True, False, True, False, False]
    assert N.is_unit_price("avg_unit_price") and not N.is_unit_price("price_total")


def test_time_range_bounds():
    thursday = dt.date(2026, 4, 9)
    assert Q.time_bounds("last_week", thursday) == (dt.date(2026, 3, 30), dt.date(2026, 4, 5))
    assert Q.time_bounds("last_month", thursday) == (dt.date(2026, 3, 1), dt.date(2026, 3, 31))
    assert Q.time_bounds("last_1_days", thursday) == (thursday, thursday) and Q.time_bounds("soon", thursday) is None


def test_empty_analysis(spark, one):
    answer = Q.analysis_query(one, Q.Intent("v", None, "sum", (("s", "==", "nope"),)))
    assert answer.rows.count() == 0 and answer.summary.first()["filtered_rows"] == 0


def test_cleaning_plan(spark, one):
    with pytest.raises(ValueError):
        apply_step(one, Step("shrink"))
    plan = last_per_column([MissingChoice("v", "zero"), MissingChoice("s", "mode"), MissingChoice("v", "mean")])
    assert [(c.column, c.method) for c in plan] == [("s", "mode"), ("v", "mean")]
    assert [s.kind for s in missing_steps([MissingChoice("v", "none"), MissingChoice("s", "drop_column")])] == ["drop_columns"]
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 3.0)], "id int, v double")
    out, audit = audited_plan(df, [Step("drop_missing_rows", columns=("v",)), Step("none"), Step("outlier", column="v", method="mark")])
    assert [tuple(r)[4:8] for r in audit.collect()] == [(3, 2, 2, 2), (2, 2, 2, 3)] and out.count() == 2
    dup = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "_row_id int, s string")
    left = rows_left_of_groups(dup, DuplicateChoice("drop_selected", (2,)))
    assert [r["_row_id"] for r in left.collect()] == [1]
    with pytest.raises(ValueError):
        K.log1p(spark.createDataFrame([(-2.0,)], "v double"), "v")
    with pytest.raises(ValueError):
        O.outliers_to_quantile(one, "v", 0.9, 0.1)


def test_append(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2, 5)], "k int, n int")
    out = A.append_tables({"a": a, "b": b}, [A.Fill("n", "unknown"), A.Fill("s", "custom", "none")])
    assert sorted(map(tuple, out.collect())) == [(1, "x", "未知"), (2, "none", "5")]
    assert A.append_audit({"a": a, "b": b}, out).first()["row_count_matches"]
    assert A.schema_similarity({"a": a, "b": b}) == 0.3333
    with pytest.raises(ValueError):
        A.append_tables({"a": a})


def test_join_risk(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (1,), (9,)], "k int")
    s = J.join_risk(J.join_stats(left, "k", right, "k")).first()
    assert (s["match_rate"], s["expansion_factor"], s["risk"]) == (2 / 3, 2.0, "medium")
    assert "right_key_not_unique" in s["reasons"]
    assert J.join_risk(J.join_stats(left, "nope", right, "k")).first()["reasons"] == "missing_field"


def test_kpi_ids():
    assert kpi.candidate_id("a", "sum", "x", "core") == kpi.candidate_id("a", "sum", "x", "core") != kpi.candidate_id("b", "sum", "x", "core")


def test_time_too_dense_and_gaps(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2026-01-01 10:00:00",), ("bad",)], "t string")
    assert L.time_summary(df, "t", "day").first()["status"] == "too_dense" and L.time_distribution(df, "t", "day").count() == 2193
    rows = L.time_distribution(df, "t", "year")
    assert [r["count"] for r in rows.orderBy("period_start").collect()] == [1, 0, 0, 0, 0, 0, 1]
    gap = L.zero_ranges(rows).first()
    assert (gap["start_label"], gap["end_label"], gap["period_count"]) == ("2021", "2025", 5)
    with pytest.raises(ValueError):
        L.time_distribution(df, "t", "hour")


def test_mixed_dates_3988(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i % 90) for i in range(3988)]
    df = spark.createDataFrame([(f"{d} 08:00:00" if i % 2 else str(d),) for i, d in enumerate(days)], "t string")
    r = L.time_summary(df, "t").first()
    assert r["valid_count"] == 3988 and r["selected"] == "day"


def test_correlation_rules(spark):
    rows = [(float(i), float(-i), 1.0, float("inf") if i == 3 else float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["field_a"], r["field_b"]): r for r in R.correlation_pairs(df, ["a", "b", "c", "d", "a"], threshold=0.0).collect()}
    assert got[("a", "b")]["correlation"] == pytest.approx(-1) and got[("a", "b")]["near_complete"]
    assert got[("a", "d")]["sample_size"] == 29 and ("a", "c") not in got
    assert R.usable_columns(df, ["c", "zz"])[1].count() == 2
    with pytest.raises(ValueError):
        R.correlation_pairs(df, ["a", "b"], "kendall")
    assert R.scatter_info(df, "a", "a").first()["status"] == "invalid_fields"


def test_questions(spark):
    q = ["各产品销售额前5名", "最近 7 天 趋势", "利润最高的 3 个区域", "销售额最高的二十一个", "", None, "近3个月增长最快的前三个"]
    got = question_tags(spark.createDataFrame([(i, t) for i, t in enumerate(q)], "question_id int, question string")).orderBy("question_id").collect()
    assert [r["intent"] for r in got] == ["ranking", "trend", "ranking", "ranking", "unknown", "unknown", "ranking"]
    assert [r["top_n"] for r in got] == [5, None, 3, 1, None, None, 1]
    assert got[1]["time_range"] == "最近7天" and got[3]["query_limit"] == 21 and got[6]["query_limit"] == 3 and got[6]["recent_months"] == 3
    multi = spark.createDataFrame([("销售额排名？利润趋势？",), ("销售额排名",), ("小组和区域销售额分别是多少",)], "question string")
    assert [r["is_multi"] for r in question_multi(multi).collect()] == [True, False, True]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "gb18030", "latin1"])
def test_csv_encodings(spark, tmp_path, encoding):
    text = "区域,amount\n华东,1\n华南,2\n" if encoding != "latin1" else "region,amount\n\xe9,1\n\xfc,2\n"
    (tmp_path / "x.csv").write_bytes(text.encode(encoding))
    df = read_csv(spark, str(tmp_path / "x.csv"))
    first = text.splitlines()
    assert df.columns == first[0].split(",") and [r[0] for r in df.collect()] == [line.split(",")[0] for line in first[1:]]
    assert df.agg(F.sum("amount")).first()[0] == 3


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "华东")], "id int, l array<int>, s string")
    write_csv(df, str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    assert tuple(read_csv(spark, str(tmp_path / "out")).first()) == (1, "[1,2]", "华东")


def test_event_log(spark, tmp_path):
    lines = ['{"event_name":"a","timestamp":"2026-01-02","success":true}', "oops", '{"event_name":"b","timestamp":"2026-01-03","success":false}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert read_events(spark, str(tmp_path)).count() == 2
    assert read_events(spark, str(tmp_path), last=1).first()["event_name"] == "b"
    props = json.dumps({"Phone_No": 1, "n": 2, "o": {"email": "x", "deep": {"mobile": 3, "k": True}}, "l": [1, 2], "m": [{"a": 1}]})
    for levels in (4, 7, 12):  # never in clear, however deep
        deep = '{"a": ' * levels + '{"phone": "123", "k": 1}' + "}" * levels
        text = spark.createDataFrame([(deep,)], "p string").select(redact(F.col("p"))).first()[0]
        assert "123" not in text and "[redacted]" in text and ('"k":1' in text) == (levels < 8)
    got = json.loads(spark.createDataFrame([(props,)], "p string").select(redact(F.col("p"))).first()[0])
    assert got == {"Phone_No": "[redacted]", "n": 2, "o": {"email": "[redacted]", "deep": {"mobile": "[redacted]", "k": True}}, "l": [1, 2], "m": "[omitted list]"}


def test_redaction_parses_a_row_once(spark):
    """Levels are walked as variants: the text of the properties is read into a map once, not once a level."""
    rows = [('{"z": 1e2, "o": {"b": 1e2, "a": {"Email": {"x": 1}, "l": [1, "[2]"], "m": [[1]], "n": null}}, "s": "{phone}"}',
             '{"z":100.0,"o":{"a":{"Email":"[redacted]","l":[1,"[2]"],"m":"[omitted list]","n":null},"b":100},"s":"{phone}"}'),
            ('{"o": {}, "l": [], "n": null, "mobile": [{"a": 1}]}', '{"o":{},"l":[],"n":null,"mobile":"[redacted]"}'),
            ('[{"phone": 1}]', None), ("oops", None), (None, None)]
    got = spark.createDataFrame(rows, "p string, want string").select(redact(F.col("p")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in got.collect())
    plan = str(spark.range(1).select(redact(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan())
    assert plan.count("from_json(") == 1
