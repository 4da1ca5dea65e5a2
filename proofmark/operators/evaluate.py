"""Scoring of answers against expectations, and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.operators.ordering import exact_medians
from proofmark.operators.profile import comparable
from proofmark.operators.sql_guard import cleaned_sql, policy_reason


def numerical_score(actual: Column, expected: Column, tolerance: Column) -> Column:
    """1 when close by relative or absolute tolerance, else 0; NULL and NaN score 0."""
    bound = F.greatest(tolerance * F.greatest(F.abs(actual), F.abs(expected)), tolerance)
    gap = F.abs(actual - expected)
    # NaN and infinite gaps are not below infinity; equal infinities match by equality.
    near = (gap < float("inf")) & (gap <= bound)
    close = ((actual == expected) & ~F.isnan(actual)) | near
    return F.when(F.coalesce(close, F.lit(False)), 1.0).otherwise(0.0)


def expectation_score(
    actual: Column,
    actual_text: Column,
    one_of: Column,
    lt: Column,
    gt: Column,
    value: Column,
    value_text: Column,
    tolerance: Column,
) -> Column:
    """First matcher given wins: one_of, lt, gt, number, text; NULL never beats a bound."""

    def point(condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)

    return (
        F.when(one_of.isNotNull(), point(F.array_contains(one_of, actual_text)))
        .when(lt.isNotNull(), point(actual < lt))
        .when(gt.isNotNull(), point(actual > gt))
        .when(value.isNotNull(), numerical_score(actual, value, F.coalesce(tolerance, F.lit(1e-6))))
        .otherwise(point(actual_text.eqNullSafe(value_text)))
    )


def evidence_coverage(report: Column, keys: Column) -> Column:
    """Share of the keys cited as evidence:<key>; 0 without keys."""
    cited = F.filter(keys, lambda key: F.contains(report, F.concat(F.lit("evidence:"), key)))
    return F.coalesce(
        F.try_divide(F.size(cited).cast("double"), F.nullif(F.size(keys), F.lit(0))), F.lit(0.0)
    )


def select_evidence_cell(rows: Column, index: Column, field: Column) -> Column:
    """Text of one field in one JSON evidence row; NULL when the row does not exist."""
    row = F.when(index >= 0, F.try_element_at(rows, index + 1))
    path = F.concat(F.lit("$."), field)
    return F.call_function("get_json_object", row, path)


def rows_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do both sides hold the same rows, with the same multiplicity?

    One shuffle of partial sums (+1 left, -1 right) instead of two set differences.
    """
    keys = [comparable(f).alias(f"k{i}") for i, f in enumerate(left.schema)]
    other = right.select(*[F.col(c).cast(left.schema[c].dataType).alias(c) for c in left.columns])
    tagged = left.select(*keys, F.lit(1).alias("side")).unionAll(other.select(*keys, F.lit(-1)))
    balance = tagged.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.sum("side").alias("b"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest(F.col("b"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("b"), F.lit(0))), F.lit(0)).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def faulty_record_ids(records: DataFrame, column: str = "id") -> DataFrame:
    """Ids that are missing or occur more than once, with their count."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    counts = records.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("id") == "") | (F.col("n") > 1)).withColumn(
        "problem", F.when(F.col("id") == "", "missing").otherwise("duplicate")
    )


def record_status(results: DataFrame) -> DataFrame:
    """passed: executed, full score, and no recorded check is false."""
    passed = (
        F.coalesce(F.col("execution_success"), F.lit(False))
        & F.coalesce(F.col("score") == 1.0, F.lit(False))
        & F.coalesce(F.col("read_only_sql_valid"), F.lit(True))
        & F.coalesce(F.col("reproducible"), F.lit(True))
    )
    return results.withColumn("status", F.when(passed, "passed").otherwise("failed"))


def evaluate_records(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Score every record against the answer with its id: one table job.

    ``records``: id, category, evidence_key, row, field and the expectation one_of, lt, gt, value,
    value_text, tolerance.  ``answers``: id, execution_success, evidence
    array<struct<key, rows array<json text>>>, answer, sqls, reproducible, latency_ms.  A record
    without an answer fails.  The result goes to ``benchmark_summary`` and
    ``benchmark_by_category``.
    """
    found = F.get(F.filter("evidence", lambda e: e["key"] == F.col("evidence_key")), F.lit(0))
    text = F.col("_text")
    number = text.try_cast("double")
    scored = (
        records.join(answers, "id", "left")
        .withColumn("_text", select_evidence_cell(found["rows"], F.col("row"), F.col("field")))
        .withColumns(
            {
                "execution_success": F.coalesce("execution_success", F.lit(False)),
                "score": expectation_score(
                    number, text, F.col("one_of"), F.col("lt"), F.col("gt"), F.col("value"),
                    F.col("value_text"), F.col("tolerance"),
                ),
                "numeric_case": F.col("value").isNotNull(),
                "evidence_coverage": evidence_coverage(
                    F.col("answer"), F.transform("evidence", lambda e: e["key"])
                ),
                "read_only_sql_valid": F.forall(
                    "sqls", lambda sql: policy_reason(cleaned_sql(sql)).isNull()
                ),
            }
        )
        .withColumn("score", F.when(F.col("execution_success"), F.col("score")).otherwise(0.0))
        .withColumnRenamed("_text", "actual")
    )
    return record_status(scored).select(
        "id", "category", "status", "score", "actual", "execution_success", "numeric_case",
        "evidence_coverage", "read_only_sql_valid", "reproducible", "latency_ms",
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """One row of totals and rates; the median latency is exact at any size."""
    def given(name: str) -> Column:
        return F.count(F.col(name))

    def true(name: str) -> Column:
        return F.count_if(F.col(name))

    numeric_score = F.when(F.col("numeric_case"), F.col("score"))
    sums = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"),
        true("execution_success").alias("execution_passed"),
        F.count_if(numeric_score == 1.0).alias("numeric_passed"),
        F.count(numeric_score).alias("numeric_total"),
        F.coalesce(F.avg(numeric_score), F.lit(0.0)).alias("numeric_rate"),
        given("evidence_coverage").alias("coverage_total"),
        F.coalesce(F.avg("evidence_coverage"), F.lit(0.0)).alias("coverage_score"),
        true("read_only_sql_valid").alias("policy_passed"),
        given("read_only_sql_valid").alias("policy_total"),
        true("reproducible").alias("reproducible_passed"),
        given("reproducible").alias("reproducible_total"),
    )
    median = exact_medians(results, ["latency_ms"]).select(
        F.coalesce("median", F.lit(0.0)).alias("median_latency_ms"), F.lit(1).alias("_one")
    )
    with_rates = sums.withColumns(
        {
            "failed": F.col("total") - F.col("passed"),
            "execution_rate": _rate(F.col("execution_passed"), F.col("total")),
            "policy_rate": _rate(F.col("policy_passed"), F.col("policy_total")),
            "reproducible_rate": _rate(F.col("reproducible_passed"), F.col("reproducible_total")),
            "_one": F.lit(1),
        }
    )
    return with_rates.join(median, "_one").drop("_one")


def benchmark_by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.avg("score").alias("score"),
    )
