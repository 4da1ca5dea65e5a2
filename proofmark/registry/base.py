"""Registration of the runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equal DuckDB text, if SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def fixed(value: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, to compare across engines."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def labelled_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with their labels where there are any: the table with natural NULLs."""
    return table(spark, directory, "documents").join(
        table(spark, directory, "labels"), "doc_id", "left"
    )


LABELLED_SQL = (
    "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
