"""Read-only SQL over the view ``dataset``: policy as a column, and guarded execution."""

from __future__ import annotations

import re
from threading import Lock, Timer
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions.columns import json_safe
from proofmark.plans.wording import (
    FORBIDDEN_SQL_FUNCTIONS,
    FORBIDDEN_SQL_WORDS,
    NO_RESULT,
    POLICY_REASONS,
)
from proofmark.sources.sinks import MAX_ROWS

# Ways out of a SELECT that exist in Spark: static Java calls, shell transforms, and the
# name of the file behind a row.
SPARK_FORBIDDEN_WORDS = (
    "reflect",
    "try_reflect",
    "java_method",
    "input_file_name",
    "input_file_block_start",
    "input_file_block_length",
)
# The rules in order of precedence: (reason, pattern, must the pattern match?).
RULES = (
    ("empty", r"^\s*\z", False),
    ("statements", r";", False),
    ("kind", r"(?i)^(select|with)\b", True),
    ("comment", r"--|/\*|\*/", False),
    ("mutation", r"(?i)\b(" + "|".join(FORBIDDEN_SQL_WORDS) + r")\b", False),
    ("external", r"(?i)" + "|".join(FORBIDDEN_SQL_FUNCTIONS), False),
    ("external", r"(?i)\b(" + "|".join(SPARK_FORBIDDEN_WORDS) + r")\b", False),
    # TRANSFORM/MAP/REDUCE ... USING 'command'; a join's USING is followed by a parenthesis.
    ("external", r"(?i)\busing\s*['\"]", False),
)
_TRAILING = r"[;\s]*\z"


class SQLPolicyError(ValueError):
    pass


class SQLTimeoutError(TimeoutError):
    pass


def cleaned_sql(sql: Column) -> Column:
    """Statement text without surrounding blanks and closing semicolons."""
    return F.regexp_replace(F.regexp_replace(sql, r"^\s+", ""), _TRAILING, "")


def policy_reason(clean: Column) -> Column:
    """First broken rule of a cleaned statement, or NULL; NULL text counts as empty."""
    text = F.coalesce(clean, F.lit(""))
    chain = None
    for reason, pattern, wanted in RULES:
        broken = ~text.rlike(pattern) if wanted else text.rlike(pattern)
        message = F.lit(POLICY_REASONS[reason])
        chain = F.when(broken, message) if chain is None else chain.when(broken, message)
    return chain


def audit_sql(log: DataFrame, column: str = "sql") -> DataFrame:
    """Policy verdict for every statement of a query log."""
    cleaned = log.withColumn("clean_sql", cleaned_sql(F.col(column)))
    return cleaned.withColumn("reason", policy_reason(F.col("clean_sql"))).withColumn(
        "allowed", F.col("reason").isNull()
    )


def check_sql(sql: str) -> str:
    """Driver-side form of the same rules for one statement."""
    text = re.sub(_TRAILING.replace(r"\z", r"\Z"), "", sql.lstrip())
    for reason, pattern, wanted in RULES:
        if bool(re.search(pattern.replace(r"\z", r"\Z"), text)) != wanted:
            raise SQLPolicyError(POLICY_REASONS[reason])
    return text


# Leaves of an analysed plan that read no table: constants, parts of the statement itself,
# and number ranges.
_OWN_LEAVES = ("OneRowRelation", "LocalRelation", "CTERelationRef", "Range")


def _reads_only_dataset(node) -> bool:
    """Does an analysed plan, with its subqueries, read nothing but the view ``dataset``?"""
    kind = node.getClass().getSimpleName()
    if kind == "View":
        name = node.desc().identifier()
        return node.isTempView() and name.table() == "dataset" and name.database().isEmpty()
    children, subqueries = node.children(), node.subqueries()
    if children.isEmpty() and kind not in _OWN_LEAVES:
        return False
    return all(
        _reads_only_dataset(part.apply(i)) for part in (children, subqueries) for i in range(part.size())
    )


_view_lock = Lock()


def guarded_sql(spark: SparkSession, df: DataFrame, sql: str, cap: int | None = MAX_ROWS) -> DataFrame:
    """One allowed SELECT over ``df`` as ``dataset``; analysis errors raise here, before any job.

    ``cap`` is the row limit of a report; None returns the whole result.
    """
    text = check_sql(sql)
    with _view_lock:
        df.createOrReplaceTempView("dataset")
        on_files = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            result = spark.sql(text)  # analysed now; the view may change afterwards
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", on_files)
            spark.catalog.dropTempView("dataset")
    if not _reads_only_dataset(result._jdf.queryExecution().analyzed()):
        raise SQLPolicyError(POLICY_REASONS["external"])
    return result if cap is None else result.limit(cap)


def collect_guarded(
    spark: SparkSession, df: DataFrame, sql: str, cap: int = MAX_ROWS, timeout_seconds: float = 30
) -> dict:
    """Rows of a guarded query; its jobs are cancelled after the timeout."""
    result = guarded_sql(spark, df, sql, cap)
    result = result.select(*[json_safe(field) for field in result.schema])
    group = f"guarded-{uuid4().hex}"
    context = spark.sparkContext
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    expired = []

    def cancel() -> None:
        expired.append(True)
        context.cancelJobGroup(group)

    timer = Timer(timeout_seconds, cancel)
    timer.start()
    try:
        rows = result.collect()
    except Exception as error:
        if expired:
            raise SQLTimeoutError(f"Query melebihi timeout {timeout_seconds} detik.") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return {
        "columns": result.columns,
        "rows": [row.asDict(recursive=True) for row in rows],
        "row_count": len(rows),
        "truncated": len(rows) >= cap,
        "sql": check_sql(sql),
        "engine": "spark",
    }


# --- audit of finished analyses --------------------------------------------------------


def missing_required(plans: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plan columns the dataset does not have.

    ``plans``: analysis_id, dataset_id, required_columns; ``catalog``: dataset_id, column.
    The catalog is folded to one row per dataset, so each plan meets one row.
    """
    known = catalog.groupBy("dataset_id").agg(F.collect_set("column").alias("_known"))
    return (
        plans.join(known, "dataset_id", "left")
        .withColumn(
            "missing_columns",
            F.array_except("required_columns", F.coalesce("_known", F.array().cast("array<string>"))),
        )
        .drop("_known")
    )


def critic_verdict(checks: DataFrame) -> DataFrame:
    """Issues, verdict and check flags per analysis, from bounded per-analysis arrays.

    ``checks``: analysis_id, missing_columns array, sqls array, result_count, errors array.
    All of it is row local: no grouping, no shuffle.
    """
    missing = F.when(
        F.size("missing_columns") > 0,
        F.array(
            F.struct(
                F.lit("missing_column").alias("type"),
                F.array_join("missing_columns", ", ").alias("message"),
            )
        ),
    )
    empty = F.when(
        F.col("result_count") == 0,
        F.array(
            F.struct(
                F.lit("empty_execution").alias("type"),
                F.lit(NO_RESULT).alias("message"),
            )
        ),
    )
    unsafe = F.filter(
        F.transform(
            F.transform("sqls", cleaned_sql),
            lambda sql: F.struct(F.lit("unsafe_sql").alias("type"), policy_reason(sql).alias("message")),
        ),
        lambda item: item["message"].isNotNull(),
    )
    failed = F.transform(
        "errors",
        lambda text: F.struct(F.lit("execution_error").alias("type"), text.alias("message")),
    )
    none = F.array().cast("array<struct<type:string,message:string>>")
    issues = F.concat(*[F.coalesce(part, none) for part in (missing, empty, unsafe, failed)])
    with_issues = checks.withColumn("issues", issues)

    def has(kind: str) -> Column:
        return F.exists("issues", lambda item: item["type"] == kind)

    return with_issues.select(
        "analysis_id",
        "issues",
        F.when(F.size("issues") > 0, "revision_required").otherwise("passed").alias("status"),
        (~has("missing_column")).alias("required_columns_exist"),
        (~has("unsafe_sql")).alias("queries_read_only"),
        (~has("execution_error")).alias("executed_without_error"),
    )
