"""Registered queries against DuckDB over the smallest tables; TALLY_ALL=1 runs every one."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tallyframe.catalog import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
CORE = ("src_csv", "field_profile", "describe_all", "detect_types", "field_roles", "missing_summary", "outlier_summary", "quality_score_v2",
        "cleaning_plan", "duplicate_plan", "append_tables", "join_plan", "left_join", "build_analysis_audit", "analysis_query", "kpi_board",
        "period_dashboard_week", "dimension_trend", "growth_ranking", "numeric_distribution", "category_composition", "time_distribution",
        "growth_ranking_many", "sink_events_nested", "time_distribution_days", "zero_ranges_days", "question_totals", "preview_sample",
        "scatter_sample", "correlation_pairs", "spearman_rank", "eda_flags", "event_dedup_once", "event_stream_counts", "question_confidence",
        "dimension_rollup", "dimension_rollup_sets", "moving_sum", "as_of_join", "range_join", "rows_changed", "diff_summary",
        "event_property_paths", "event_property_columns", "event_property_groups")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("TALLY_ALL") else CORE)
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, DATA)
    rel = con.sql(oracle_sql()[name])
    keys = sorted(df.columns)
    assert keys == sorted(rel.columns)
    at = {c: i for i, c in enumerate(rel.columns)}
    got = sorted([tuple(plain(r[k]) for k in keys) for r in df.collect()], key=repr)
    want = sorted([tuple(plain(r[at[k]]) for k in keys) for r in rel.fetchall()], key=repr)
    assert got == want


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and [r["rank"] for r in rows] == list(range(1, 11))
