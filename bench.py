"""Headline queries timed at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1; the median of more).
Each query is warmed up once and then written to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tenantlake.plans import REGISTRY
from tenantlake.session import get_session

HEADLINE = [
    "delivered_to_monthly_summary", "bronze_to_silver", "deduplicate_last", "etl_metrics", "quality_rules",
    "quality_rules_by_supplier", "row_verdicts", "keyword_rules", "keyword_rules_references",
    "batch_summary_daily", "batch_summary_monthly", "quality_trend_monthly", "supplier_scorecard",
    "drill_down_supplier_domain", "detect_pii", "pii_counts", "mask_hash", "row_level_security", "combined_filter",
    "apply_receipts", "overdue_elements", "batch_board", "delivered_file_status", "availability",
    "running_availability", "sla_compliance", "metric_series", "all_alarms", "classify_errors", "pending_work",
    "comprehensive_report", "signatures", "infer_csv_schema", "infer_json_schema", "assign_contract_ids",
    "validate_contracts", "document_lines", "document_forms", "retention_classes", "parsed_paths",
    "sql_inner_join", "sql_range_join", "sql_grouping", "sql_grouping_sets", "sql_analytic_windows",
    "stream_availability",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in only or HEADLINE:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].fn(spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
