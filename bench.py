"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed end to end (planning, eager steps, and writing the full result to the
no-op sink), best of two runs in one warm session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "total_metric",
    "grouped_aggregate",
    "top_segments",
    "monthly_comparison",
    "segment_contribution",
    "missing_values",
    "profile_duplicates",
    "profile_distinct",
    "profile_numeric",
    "profile_table",
    "group_descriptives",
    "levene_median",
    "mann_whitney_u",
    "spearman",
    "compare_groups",
    "chi_square",
    "average_rank",
    "plan_questions",
    "audit_sql_policy",
    "sql_window",
    "benchmark_summary",
    "step_sequence",
    "assemble_trace",
    "answer_question",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from proofmark.registry import QUERIES
    from proofmark.workspace import remove_scratch

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
