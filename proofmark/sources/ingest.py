"""Admitting files, fingerprints, and the dataset catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.operators.profile import comparable
from proofmark.plans.wording import INGEST_REASONS, SUPPORTED_EXTENSIONS

MAX_FILE_MB = 100

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("fingerprint", T.StringType(), False),
        T.StructField("schema_json", T.StringType()),
        T.StructField("profile_json", T.StringType()),
        T.StructField("storage_uri", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)


def file_verdict(name: Column, size: Column, max_mb: int = MAX_FILE_MB) -> Column:
    """Why a file is refused, or NULL."""
    base = F.trim(F.regexp_extract(name, r"([^/]*)$", 1))
    extension = F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))
    return (
        F.when(base.isin("", ".", ".."), INGEST_REASONS["name"])
        .when(~extension.isin(*SUPPORTED_EXTENSIONS), INGEST_REASONS["format"])
        .when(size <= 0, INGEST_REASONS["empty"])
        .when(size > max_mb * 1024 * 1024, INGEST_REASONS["size"] % max_mb)
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File manifest; the content column is pruned, so no file is opened.

    Spark's file scan leaves out files of zero bytes, so those are never admitted; a
    manifest from another listing that has them gets the verdict "empty".
    """
    return _files(spark, path).select("path", "length")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def admit_files(manifest: DataFrame, max_mb: int = MAX_FILE_MB) -> DataFrame:
    return manifest.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.col("length").alias("size_bytes"),
        file_verdict(F.col("path"), F.col("length"), max_mb).alias("reason"),
    ).withColumn("accepted", F.col("reason").isNull())


def fingerprint_files(spark: SparkSession, path: str, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """SHA-256 of each admitted file, and a row with the reason for every other one.

    A task loads a file as a whole, so the size limit, which is part of the admission rules,
    also bounds its memory; the filter reaches the scan, and larger files are not opened.
    """
    name, size = F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length")
    files, limit = _files(spark, path), max_mb * 1024 * 1024
    read = files.where(size <= limit).select(
        name,
        size.alias("size_bytes"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("fingerprint"),
        file_verdict(F.col("path"), size, max_mb).alias("reason"),
    )
    refused = files.where(size > limit).select(
        name,
        size.alias("size_bytes"),
        F.lit(None).cast("string").alias("fingerprint"),
        file_verdict(F.col("path"), size, max_mb).alias("reason"),
    )
    return read.unionByName(refused)


def fingerprint_table(df: DataFrame) -> DataFrame:
    """Content fingerprint that ignores row order and file layout."""
    row = F.xxhash64(*[comparable(f) for f in df.schema])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("content_sum"),
    ).withColumn(
        "fingerprint",
        F.concat(
            F.lit("rows256:"),
            F.sha2(
                F.concat_ws("|", F.lit(df.schema.simpleString()), "row_count", "content_sum"), 256
            ),
        ),
    )


def dedupe_ingest(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per fingerprint of a batch: the file that stands for it, how many files
    carry it, and whether the catalog has it already.

    ``files``: name, fingerprint, size_bytes.  The first name is a partial aggregate, so a
    fingerprint shared by very many copies never meets in one task.
    """
    batch = files.groupBy("fingerprint").agg(
        F.min("name").alias("name"),
        F.min("size_bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("file_count"),
    )
    known = catalog.groupBy("fingerprint").agg(F.min("id").alias("existing_id"))
    return batch.join(known, "fingerprint", "left").withColumn(
        "is_new", F.col("existing_id").isNull()
    )


def register(rows: DataFrame, path: str) -> None:
    """Append catalog rows."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG_SCHEMA]).write.mode(
        "append"
    ).parquet(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("created_at"), "id")
