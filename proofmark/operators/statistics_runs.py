"""Several statistics requests on one table, with failures as rows and a trace of every run.

A request names a method and columns, as for ``run_statistics``.  A request that cannot be
answered (unknown method, missing column, too few groups, an error while it runs) gives a row
with status "failed" and the reason, and the others go on.  Requests are a list written by a
user; each test itself is a table job, and only its one result row comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from time import perf_counter

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.operators.statistics import StatisticsError, run_statistics, statistics_report
from proofmark.workspace import local_table

AGENT = "statistics_agent"
_COLUMNS = ("outcome", "group", "x", "y")
_FIELDS = {
    "position": pa.int64(),
    "requested": pa.string(),
    "method": pa.string(),
    "status": pa.string(),
    "p_value": pa.float64(),
    "significant": pa.bool_(),
    "request_json": pa.string(),
    "result_json": pa.string(),
    "error": pa.string(),
    "latency_ms": pa.int64(),
}


def _run(df: DataFrame, position: int, request: Mapping[str, object]) -> dict[str, object]:
    method = str(request.get("method") or "auto")
    named = {c: request[c] for c in _COLUMNS if request.get(c)}
    alpha = float(request.get("alpha", 0.05))
    row = dict.fromkeys(_FIELDS) | {
        "position": position,
        "requested": method,
        "request_json": json.dumps({"method": method, **named, "alpha": alpha}),
    }
    started = perf_counter()
    try:
        result = run_statistics(df, method, **named, alpha=alpha).first().asDict(recursive=True)
        row |= {c: result[c] for c in ("method", "p_value", "significant")}
        row |= {"status": "completed", "result_json": json.dumps(result, default=str)}
    except (StatisticsError, PySparkException) as error:
        row |= {"status": "failed", "error": str(error)}
    return row | {"latency_ms": int((perf_counter() - started) * 1000)}


def run_requests(df: DataFrame, requests: Sequence[Mapping[str, object]]) -> DataFrame:
    """One row per request, in order (``position`` from 1), with the answer or the reason."""
    rows = [_run(df, i, request) for i, request in enumerate(requests, 1)]
    runs = local_table(
        df.sparkSession, {name: (kind, [r[name] for r in rows]) for name, kind in _FIELDS.items()}
    )
    # The join key is unique: at most one answer per run.
    answers = statistics_report(runs.where("status = 'completed'"), "position").select("position", "answer")
    return runs.join(answers, "position", "left")


def trace_parts(runs: DataFrame, prefix: str = "statistics") -> dict[str, DataFrame]:
    """The runs as tables for ``assemble_trace``: one analysis and one step per request, and an
    evaluation for each completed one."""
    runs = runs.withColumn("analysis_id", F.concat(F.lit(f"{prefix}-"), F.col("position")))
    step = F.struct(
        F.lit(AGENT).alias("agent"),
        F.col("request_json").alias("input"),
        F.coalesce("result_json", F.to_json(F.struct("error"))).alias("output"),
        "latency_ms",
        F.when(F.col("status") == "completed", "success").otherwise("failure").alias("status"),
    )
    score = F.struct(
        F.lit("statistical_validity").alias("metric"), F.lit(1.0).alias("score"), "method"
    )
    return {
        "analyses": runs.select("analysis_id", "status", F.col("answer").alias("final_answer"), "error"),
        "steps": runs.select(
            "analysis_id",
            F.lit(1).alias("sequence"),
            F.concat("analysis_id", F.lit("-step")).alias("id"),
            F.to_json(step).alias("payload"),
        ),
        "artifacts": runs.limit(0).select(
            "analysis_id", F.col("position").alias("created_at"), F.lit("").alias("id"), F.lit("").alias("payload")
        ),
        "evaluations": runs.where("status = 'completed'").select(
            "analysis_id",
            F.col("position").alias("created_at"),
            F.concat("analysis_id", F.lit("-validity")).alias("id"),
            F.to_json(score).alias("payload"),
        ),
    }
