"""Headline queries on one data set; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS.
Derived tables (landed lines, export, manifest, ledger) are written first, as a run
would find them, and timed as ``write_<table>``; ``prepare`` is their sum.
"""

from __future__ import annotations

import json
import os
import time

from casegate.catalog import all_queries
from casegate.catalog import bindings as b
from casegate.session import local_session

HEADLINE = [
    "scan_export_lines",
    "source_line_number",
    "split_fields",
    "prevalidate",
    "normalise_inputs",
    "decision_table_join",
    "classify_baseline",
    "classify_text_export",
    "classification_report",
    "domain_coverage",
    "manifest_verify",
    "expectation_diff",
    "rule_change_diff",
    "field_profile",
    "load_plan",
    "ledger_fold",
    "write_ledger",
    "illegal_transitions",
    "bucket_counts",
    "gate_checks",
    "held_not_alive",
    "abort_set",
    "correspondence",
    "cross_run_duplicates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cpus)
    queries = all_queries()

    seconds = {}
    for path in (b.lines_path, b.export_path, b.manifest_path, b.expectations_path, b.snapshot_path):
        start = time.perf_counter()
        path(spark, sf_dir)
        seconds[f"write_{path.__name__.removesuffix('_path')}"] = round(time.perf_counter() - start, 3)
    prepare = sum(seconds.values())
    records = b.case_lines(spark, sf_dir).count()

    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds[name] for name in HEADLINE), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall clock",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "records": records,
                "classified_per_sec": round(records / seconds["classify_text_export"]),
                "prepare": round(prepare, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
