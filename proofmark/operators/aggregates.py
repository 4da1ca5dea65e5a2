"""Totals, rankings, month comparisons and missing-value reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.columns import (
    col,
    equals_all,
    in_two_months,
    null_to_zero,
    previous_month,
)
from proofmark.operators import profile
from proofmark.workspace import pin

TOP_SEGMENTS = 10


def summable(df: DataFrame, metric: str) -> Column:
    """Integers are added as DECIMAL(38,0): a long sum overflows on very large tables."""
    integral = isinstance(df.schema[metric].dataType, T.IntegralType)
    return col(metric).cast("decimal(38,0)") if integral else col(metric)


def total_metric(df: DataFrame, metric: str, filters: Mapping[str, str] | None = None) -> DataFrame:
    return df.where(equals_all(filters or {})).agg(
        F.sum(summable(df, metric)).alias("metric_value"),
        F.count(col(metric)).alias("non_null_count"),
    )


def average_metric(df: DataFrame, metric: str, filters: Mapping[str, str] | None = None) -> DataFrame:
    return df.where(equals_all(filters or {})).agg(
        F.avg(col(metric)).alias("metric_value"), F.count(col(metric)).alias("non_null_count")
    )


def row_count(df: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    return df.where(equals_all(filters or {})).agg(F.count(F.lit(1)).alias("row_count"))


def _ranked(value: str, tie: str) -> list[Column]:
    return [F.desc_nulls_last(value), F.asc_nulls_last(tie)]


def grouped_aggregate(
    df: DataFrame, dimension: str, metric: str, filters: Mapping[str, str] | None = None
) -> DataFrame:
    """Sum and row count per segment, largest first; NULL is a segment of its own."""
    return (
        df.where(equals_all(filters or {}))
        .groupBy(col(dimension).alias("segment"))
        .agg(F.sum(summable(df, metric)).alias("metric_value"), F.count(F.lit(1)).alias("row_count"))
        .orderBy(*_ranked("metric_value", "segment"))
    )


def top_segments(
    df: DataFrame,
    dimension: str,
    metric: str,
    filters: Mapping[str, str] | None = None,
    limit: int = TOP_SEGMENTS,
) -> DataFrame:
    return (
        grouped_aggregate(df, dimension, metric, filters)
        .select("segment", "metric_value")
        .limit(limit)
    )


def _dated(df: DataFrame, date_column: str) -> Column:
    """Text dates are cast; real dates stay untouched so that filters reach the scan."""
    value = col(date_column)
    is_text = isinstance(df.schema[date_column].dataType, T.StringType)
    return value.try_cast("timestamp") if is_text else value


def monthly_comparison(
    df: DataFrame,
    date_column: str,
    metric: str,
    current: int,
    year: int | None = None,
    filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """Metric of the previous and the current month, previous first also for January."""
    when = _dated(df, date_column)
    return (
        df.where(in_two_months(when, year, current) & equals_all(filters or {}))
        .groupBy(F.month(when).alias("month"))
        .agg(F.sum(summable(df, metric)).alias("metric_value"))
        .orderBy(F.col("month") == current)
    )


def segment_contribution(
    df: DataFrame,
    date_column: str,
    metric: str,
    dimension: str,
    current: int,
    year: int | None = None,
    filters: Mapping[str, str] | None = None,
    limit: int = TOP_SEGMENTS,
) -> DataFrame:
    """Change per segment between two months, largest drop first: one conditional
    aggregate, hence one shuffle of one partial row per segment and task."""
    when, amount = _dated(df, date_column), summable(df, metric)
    month = F.month(when)
    return (
        df.where(in_two_months(when, year, current) & equals_all(filters or {}))
        .groupBy(col(dimension).alias("segment"))
        .agg(
            null_to_zero(F.sum(F.when(month == previous_month(current), amount))).alias("previous_value"),
            null_to_zero(F.sum(F.when(month == current, amount))).alias("current_value"),
        )
        .withColumn("delta", F.col("current_value") - F.col("previous_value"))
        .orderBy(F.asc_nulls_last("delta"), F.asc_nulls_last("segment"))
        .limit(limit)
    )


def change_rate(monthly: DataFrame, current: int) -> DataFrame:
    """One row from the two monthly rows: change and relative change.

    NULL values count as 0; the rate is NULL when the previous value is 0, and everything
    is NULL unless both months have a row.
    """
    value = null_to_zero(F.col("metric_value").cast("double"))
    sides = monthly.agg(
        F.max(F.when(F.col("month") == previous_month(current), value)).alias("previous_value"),
        F.max(F.when(F.col("month") == current, value)).alias("current_value"),
    )
    change = F.col("current_value") - F.col("previous_value")
    return sides.select(
        "previous_value",
        "current_value",
        change.alias("change"),
        F.try_divide(change, F.nullif(F.col("previous_value"), F.lit(0.0))).alias("rate"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and rate per column, worst first, from a single scan."""
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    return (
        profile.missing(df, empty_rate=None)
        .orderBy(F.desc_nulls_last("missing_rate"), order[F.col("column")])
        .select("column", "missing_count", "missing_rate")
    )


def risky_columns(missing: DataFrame, first: int = 5) -> DataFrame:
    """Columns with any missing value, the ``first`` worst, and how many there are in all.

    ``missing`` has one row per column of a table, so the ranking is schema sized.
    """
    ranking = Window.partitionBy(F.lit(0)).orderBy(F.desc("missing_rate"), "column")
    everything = Window.partitionBy(F.lit(0))
    return (
        missing.where(F.col("missing_rate") > 0)
        .withColumn("risky_count", F.count(F.lit(1)).over(everything))
        .withColumn("position", F.row_number().over(ranking))
        .where(F.col("position") <= first)
    )


def leading_segments(grouped: DataFrame, first: int = 3) -> DataFrame:
    """The first segments of a grouped result and the number of segments returned.

    The result is computed once and written; its count comes from the file footers, and only
    the leading rows are numbered.
    """
    grouped = pin(grouped, "segments")
    ranking = Window.partitionBy(F.lit(0)).orderBy(*_ranked("metric_value", "segment"))
    top = grouped.orderBy(*_ranked("metric_value", "segment")).limit(first)
    return top.select(
        F.row_number().over(ranking).alias("position"),
        "segment",
        "metric_value",
        F.lit(grouped.count()).cast("long").alias("segment_count"),
    )
