"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or "all").
Each query is planned and fully executed into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tallyframe.catalog import queries  # noqa: E402
from tallyframe.session import build_session  # noqa: E402

HEADLINE = (
    "src_csv", "field_profile", "basic_info", "describe_all", "parse_datetime", "detect_types", "infer_field_mapping",
    "field_roles", "missing_summary", "duplicate_summary", "iqr_bounds", "outlier_summary", "quality_score_v2",
    "fill_median", "fill_mode", "drop_duplicates", "outlier_winsorize", "cleaning_plan", "append_tables",
    "discover_relationships", "join_stats", "left_join", "build_analysis_dataset", "analysis_query", "category_topn",
    "kpi_board", "period_dashboard", "dimension_topn", "dimension_share", "dimension_trend", "growth_ranking",
    "summary_kpis", "numeric_summary", "numeric_distribution", "histogram", "category_composition", "time_distribution",
    "correlation_pairs", "spearman_rank", "eda_report", "event_summary", "event_dedup_once", "event_stream_counts",
    "question_tags", "question_filters",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    names = list(every) if asked == "all" else ([n for n in asked.split(",") if n] or list(HEADLINE))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's workers
    times = {}
    for name in names:
        start = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
