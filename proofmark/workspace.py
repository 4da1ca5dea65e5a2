"""Session helpers: where intermediate tables live, and how to freeze one.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``, so
that a lost executor never takes the only copy along.  Where the session names none,
they go below the warehouse, which a cluster shares as well.
"""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _run_folder(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder, or else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/proofmark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of this application."""
    return f"{_run_folder(spark)}/{label}-{uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results built on them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Two uses: every later branch sees the same rows (range bounds and quantile
    sketches may differ between two evaluations of one plan), and Spark knows the
    true size, so it broadcasts the table only when it is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Nodes of a plan that reads columns of one file relation or of rows at hand.
_PLAIN = ("Project", "Filter", "LogicalRelation", "LocalRelation", "SubqueryAlias", "View")


def columnar(df: DataFrame) -> DataFrame:
    """``df`` itself if it reads plain files, else written once.

    For work that reads the columns one by one: a file scan is pruned to the column, a
    derived table would be computed again for each.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in _PLAIN:
        if node.children().isEmpty():
            return df
        node = node.children().apply(0)
    return pin(df, "columns")


# Results of at most this many rows may be carried through the driver as a local table.
_SMALL_ROWS = 1_000


def settle_rows(
    df: DataFrame, label: str, maybe_large: bool = False
) -> tuple[DataFrame, pa.Table | None]:
    """Compute a normally tiny table once; also its rows when they fit on the driver.

    Up to 1,000 rows become a local table (Spark then broadcasts it by its known size);
    a larger one is written out instead, so nothing unbounded reaches the driver.
    ``maybe_large`` writes first and looks at the size afterwards, so that a result with
    many rows is not computed twice.
    """
    if maybe_large:
        df = pin(df, label)
    rows = df.limit(_SMALL_ROWS + 1).toArrow()
    if rows.num_rows <= _SMALL_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema), rows
    return (df if maybe_large else pin(df, label)), None


def settle(df: DataFrame, label: str, maybe_large: bool = False) -> DataFrame:
    return settle_rows(df, label, maybe_large)[0]


def local_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A table of driver-side control data (schemas, one question) with a known size.

    Arrow input becomes a LocalTableScan; a list of tuples would become an RDD scan of
    unknown size, and Spark might broadcast the other, large side of a join instead.
    """
    arrays = {name: pa.array(values, type=kind) for name, (kind, values) in columns.items()}
    return spark.createDataFrame(pa.table(arrays))
