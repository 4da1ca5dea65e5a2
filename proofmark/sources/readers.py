"""Reading tables, and typing tables whose columns are all text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.columns import col
from proofmark.sources.csv_records import csv_records, unmarked
from proofmark.workspace import pin, scratch_path

# Whole-text patterns of the three inferred types.
_DATE = r"^\d{4}-\d{2}-\d{2}([T ].*)?\z"
_INTEGER = r"^\s*[+-]?\d+\s*\z"
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*\z"
_SPARK_TYPES = {"DATE": "timestamp_ntz", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with header, commas, doubled quotes, lenient rows, empty fields as NULL.

    ``multi_line`` allows line breaks inside quotes.  Files are read in splits all the same:
    ``csv_records`` finds out which lines start inside quotes, and its records, one a line,
    are written once and read by Spark's own parser.  Without ``schema`` the types come from
    all records, which costs one extra pass.  Lines end with LF or CR LF.
    """
    reader = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("quote", '"')
        .option("escape", '"')
    )
    if not multi_line:
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    names = reader.option("multiLine", True).csv(path).columns
    header = ",".join('"' + n.replace('"', '""') + '"' for n in names)
    lines = scratch_path(spark, "csv")
    csv_records(spark, path).select("record").mapInArrow(_headed(header), "value string").write.text(lines)
    reader = reader.option("multiLine", False)
    if schema:
        # Texts are unmarked, the other types never hold a line break.
        kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        found = reader.schema(kinds).csv(lines)
    else:
        found = reader.option("inferSchema", True).csv(lines).toDF(*names)
    return found.select(
        *[
            (unmarked(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name)
            for f in found.schema
        ]
    )


def _headed(header: str):
    """Every written part begins with the header."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return run


def scan_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A dataset by its extension.  CSV is rewritten as Parquet once, because profiles and
    analyses read single columns many times."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".csv"):
        return pin(scan_csv(spark, path), "dataset")
    if lowered.endswith(".parquet"):
        return scan_parquet(spark, path)
    raise ValueError("Format dataset tidak didukung.")


def infer_types(df: DataFrame) -> DataFrame:
    """DATE, BIGINT, DOUBLE or VARCHAR per text column, from all its non-empty values."""
    checks: list[Column] = []
    for i, name in enumerate(df.columns):
        text = F.nullif(col(name), F.lit(""))
        checks += [
            F.bool_and(text.rlike(_DATE)).alias(f"_date{i}"),
            F.bool_and(
                text.rlike(_INTEGER) & F.trim(text).try_cast("bigint").isNotNull()
            ).alias(f"_int{i}"),
            F.bool_and(text.rlike(_NUMBER)).alias(f"_num{i}"),
        ]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.when(F.col(f"_date{i}"), "DATE")
            .when(F.col(f"_int{i}"), "BIGINT")
            .when(F.col(f"_num{i}"), "DOUBLE")
            .otherwise("VARCHAR")
            .alias("type"),
        )
        for i, name in enumerate(df.columns)
    ]
    return df.agg(*checks).select(F.inline(F.array(*rows)))


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply inferred types; empty text and text that does not fit become NULL."""
    return df.select(
        *[
            F.nullif(col(c), F.lit("")).try_cast(_SPARK_TYPES[types.get(c, "VARCHAR")]).alias(c)
            for c in df.columns
        ]
    )
