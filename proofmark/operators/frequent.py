"""The most frequent values of many columns, exactly, without shuffling all values.

Three steps, each over all columns at once where it can be:

1. A mergeable summary of frequent items (``approx_top_k``) names candidates, in one scan.
2. One more scan counts every candidate exactly, and all other rows by hash bucket.  The count
   of a bucket is a proven upper bound for each value in it.
3. A bucket with fewer rows than the ``size``-th candidate holds no winner.  Only values of the
   other buckets are grouped and counted.

So the result is exact whatever the summary missed, and ties are complete.  Rows shuffled in
steps 1 and 2 are bounded by tasks x columns x (candidates + buckets).  A column without
frequent values (an identifier) has no candidates and is grouped as a whole.

NULLs take no part; a column without values has no rows; repeated rows count as often as they
occur.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.workspace import local_table

CANDIDATES = 64
TRACKED = 3_072
BUCKETS = 4_096


def candidates(df: DataFrame, texts: Mapping[str, Column]) -> dict[str, list[str]]:
    """At most ``CANDIDATES`` likely winners per column, by one summary each in one scan."""
    found = df.agg(
        *[
            F.call_function("approx_top_k", text, F.lit(CANDIDATES), F.lit(TRACKED)).alias(f"_t{i}")
            for i, text in enumerate(texts.values())
        ]
    ).first()
    return {
        name: [item["item"] for item in found[i] or () if item["item"] is not None]
        for i, name in enumerate(texts)
    }


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")


def _bounds(df: DataFrame, texts: Mapping[str, Column], likely: Mapping[str, list[str]]) -> dict:
    """Per column: the exact counts of its candidates, and the rows of each bucket of the rest."""
    items = []
    for i, (name, values) in enumerate(likely.items()):
        text = texts[name]
        known = text.isin(values)
        items.append(
            F.when(
                text.isNotNull(),
                F.struct(
                    F.lit(i).alias("place"),
                    F.when(known, text).alias("value"),
                    F.when(~known, _bucket(text)).alias("bucket"),
                ),
            )
        )
    counted = (
        df.select(F.inline(F.array_compact(F.array(*items))))
        .groupBy("place", "value", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = list(likely)
    found: dict[str, tuple[dict, dict]] = {name: ({}, {}) for name in names}
    # At most CANDIDATES + BUCKETS rows per column.
    for place, value, bucket, n in counted.collect():
        exact, rest = found[names[place]]
        if value is not None:
            exact[value] = n
        else:
            rest[bucket] = n
    return found


def _grouped(df: DataFrame, name: str, text: Column) -> DataFrame:
    groups = df.where(text.isNotNull()).groupBy(text.alias("value"))
    return groups.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("column"), "value", "n")


def frequent_values(df: DataFrame, texts: Mapping[str, Column], size: int) -> dict[str, DataFrame]:
    """Per column a table (column, value, n) that holds its ``size`` most frequent values and
    all that tie with the last of them, with exact counts, among others."""
    if not texts:
        return {}
    likely = {name: values for name, values in candidates(df, texts).items() if values}
    bounds = _bounds(df, texts, likely) if likely else {}
    branches = {}
    for name, text in texts.items():
        if name not in likely:
            branches[name] = _grouped(df, name, text)
            continue
        exact, rest = bounds[name]
        counts = sorted(exact.values(), reverse=True)
        least = counts[size - 1] if len(counts) >= size else 1
        known = local_table(
            df.sparkSession,
            {
                "column": (pa.string(), [name] * len(exact)),
                "value": (pa.string(), list(exact)),
                "n": (pa.int64(), list(exact.values())),
            },
        )
        open_buckets = sorted(bucket for bucket, n in rest.items() if n >= least)
        if open_buckets:
            others = df.where(~text.isin(likely[name]))
            if len(open_buckets) < len(rest):
                others = others.where(_bucket(text).isin(open_buckets))
            known = known.unionAll(_grouped(others, name, text))
        branches[name] = known
    return branches
