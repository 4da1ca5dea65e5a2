"""User Python on a table: batches in parallel, merged by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def apply_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """``function`` on every Arrow batch of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def grouped_apply(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    merge: Sequence[Column],
) -> DataFrame:
    """User aggregation in two steps: ``partial`` reduces each batch to few rows per key,
    ``merge`` (Spark aggregates) combines them.  No group has to fit into one task."""
    return apply_batches(df, partial, schema).groupBy(*keys).agg(*merge)
