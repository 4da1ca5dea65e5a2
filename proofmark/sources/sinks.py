"""Bounded results, JSON-safe rows, evidence records and append-only trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmark.functions.columns import col, json_safe

MAX_ROWS = 500


def bounded_result(df: DataFrame, cap: int = MAX_ROWS) -> DataFrame:
    """At most ``cap`` rows (a report limit), with row_count and the truncated flag.

    Exactly ``cap`` rows count as truncated.  The window sees at most ``cap`` rows.
    """
    limited = df.limit(cap)
    counted = limited.withColumn(
        "row_count", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    )
    return counted.withColumn("truncated", F.col("row_count") >= cap)


def json_safe_rows(df: DataFrame) -> DataFrame:
    """Dates as ISO text, decimals as double, binary as hex."""
    return df.select(*[json_safe(f) for f in df.schema])


def evidence_envelope(
    df: DataFrame, key: str, purpose: str, sql: str, order: list, cap: int = MAX_ROWS
) -> DataFrame:
    """One evidence record with its rows as JSON, in ``order``; at most ``cap`` rows are kept."""
    position = Window.partitionBy(F.lit(0)).orderBy(*order)
    limited = df.orderBy(*order).limit(cap)
    safe = limited.withColumn("_position", F.row_number().over(position)).select(
        "_position",
        F.to_json(
            F.struct(*[json_safe(f) for f in df.schema]), {"ignoreNullFields": "false"}
        ).alias("_row"),
    )
    packed = safe.agg(F.sort_array(F.collect_list(F.struct("_position", "_row"))).alias("_rows"))
    return packed.select(
        F.lit(f"evidence_{key}").alias("id"),
        F.lit(key).alias("key"),
        F.lit(purpose).alias("purpose"),
        F.lit(sql).alias("sql"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.transform("_rows", lambda item: item["_row"]).alias("rows"),
        F.size("_rows").alias("row_count"),
        (F.size("_rows") >= cap).alias("truncated"),
        F.lit("spark").alias("source"),
    )


def append_trace(rows: DataFrame, path: str, time_column: str = "created_at") -> None:
    """Append steps, artifacts or evaluations, partitioned by day.

    Partitioning by analysis would make one tiny file per analysis; days stay few.
    """
    rows.withColumn("event_date", F.to_date(col(time_column))).write.mode("append").partitionBy(
        "event_date"
    ).parquet(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_chart_spec(spec: DataFrame, path: str) -> None:
    spec.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The latest report; give the schema to skip the inference pass."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)
