"""Global order without a single-task window: positions, average ranks, exact medians."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmark.workspace import pin, settle_rows

# Medians of at most this many bracketed rows are finished by one sort per group.
_ONE_SORT = 1_000_000
# Half-width of the quantile bracket around the median, and the sketch accuracy.  The
# sketch error (1/accuracy) is well inside the half-width.
_HALF_WIDTH = 0.001
_ACCURACY = 10_000


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def in_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows range partitioned on ``order``, each with the number of its slice."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return pin(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def place_in_order(
    df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Add ``before``: total weight of the rows that come earlier within ``by``.

    Rows are range partitioned on (by, order), so one hot ``by`` group is spread over
    many slices.  The slices are written once, because range bounds are sampled and
    must not differ between the totals pass and the numbering pass.  Only groups that
    cross a slice border need an offset, and a border cuts at most one group, so there are
    fewer offsets than slices: they are broadcast.
    """
    keys = list(by)
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    sliced = in_slices(df, [*keys, *order])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(amount).alias("_total"))
        .select(*keys, "_slice", F.sum("_total").over(earlier).alias("_base"))
        .where(F.col("_base").isNotNull())
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = join_on_keys(sliced, F.broadcast(offsets), [*keys, "_slice"], "left")
    return placed.withColumn(
        "before",
        F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum(amount).over(inside), F.lit(0)),
    ).drop("_slice", "_base")


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, value): how often it occurs and its rank with ties averaged."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = place_in_order(counts, by, [value], weight="n")
    return placed.withColumn(
        "avg_rank", F.col("before").cast("double") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    ).drop("before")


def median_brackets(columns: Sequence[Column]) -> list[Column]:
    """Aggregates that count a column and bracket its median, for one shared scan."""
    share = F.array(F.lit(0.5 - _HALF_WIDTH), F.lit(0.5 + _HALF_WIDTH))
    found = []
    for i, column in enumerate(columns):
        value = column.cast("double")
        bounds = F.percentile_approx(value, share, F.lit(_ACCURACY))
        found += [
            F.count(value).alias(f"_n{i}"),
            bounds.getItem(0).alias(f"_lo{i}"),
            bounds.getItem(1).alias(f"_hi{i}"),
        ]
    return found


def _bracketed(
    work: DataFrame, brackets: DataFrame, keys: Sequence[str], i: int, column: str
) -> DataFrame:
    """Counts of one column up to the upper bound, with NULL for all below the bracket."""
    values = work.select(*keys, F.col(column).cast("double").alias("value"))
    low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
    values = join_on_keys(values, brackets.select(*keys, f"_lo{i}", f"_hi{i}"), keys)
    return (
        values.where(F.col("value") <= high)
        .select(*keys, F.when(F.col("value") >= low, F.col("value")).alias("value"))
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("_times"))
        .withColumn("_i", F.lit(i))
    )


def _bracketed_at_once(work: DataFrame, rows: pa.Table, columns: Sequence[str]) -> DataFrame:
    """Counts of all columns of an ungrouped table: one scan adds up what lies below each
    bracket, one takes out the values inside a bracket (about 0.2 % of the rows)."""
    values = [F.col(c).cast("double") for c in columns]
    low, high = (
        [F.lit(rows[f"{name}{i}"][0].as_py() if rows.num_rows else None).cast("double") for i in range(len(columns))]
        for name in ("_lo", "_hi")
    )
    item = [
        F.when((v >= a) & (v <= b), F.struct(F.lit(i).alias("_i"), v.alias("value")))
        for i, (v, a, b) in enumerate(zip(values, low, high))
    ]
    any_inside = reduce(lambda x, y: x | y, [(v >= a) & (v <= b) for v, a, b in zip(values, low, high)])
    inside = (
        work.where(any_inside)
        .select(F.inline(F.array_compact(F.array(*item))))
        .groupBy("_i", "value")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    sums = work.agg(*[F.count_if(v < a).alias(f"_b{i}") for i, (v, a) in enumerate(zip(values, low))])
    none = F.lit(None).cast("double")
    below = sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("_i"), none.alias("value"), F.col(f"_b{i}").alias("_times"))
                    for i in range(len(columns))
                ]
            )
        )
    )
    return inside.unionByName(below).withColumn("_all", F.lit(0))


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    brackets: DataFrame | None = None,
) -> DataFrame:
    """Exact medians: (by..., column, n, median).

    The first scan brackets each median with a quantile sketch.  Then the values inside the
    bracket (about 0.2 % of the rows) are counted one by one and everything below it as one
    NULL entry, which sorts first and so carries the offset: for a whole table with one scan
    each over all columns, for groups with one branch per column.  The median is then read off by position; no value list of a
    whole group is ever built.
    ``brackets`` takes the result of scan 1 when the caller ran it with other aggregates.
    """
    keys = list(by) or ["_all"]
    work = df if by else df.withColumn("_all", F.lit(0))
    given = brackets is not None
    if not given:
        brackets = work.groupBy(*keys).agg(*median_brackets([F.col(c) for c in columns]))
    sizes = [f"_n{i}" for i in range(len(columns))]
    brackets, rows = settle_rows(brackets, "brackets", maybe_large=bool(by) and not given)
    if rows is not None:
        largest = max((pc.max(rows[c]).as_py() or 0 for c in sizes), default=0)
    else:
        largest = brackets.agg(F.max(F.greatest(F.lit(0), *sizes))).first()[0]

    if not by and rows is not None:
        counts = _bracketed_at_once(work, rows, columns)
    else:
        counts = reduce(
            DataFrame.unionAll,
            [_bracketed(work, brackets, keys, i, c) for i, c in enumerate(columns)],
        )
    if largest * 4 * _HALF_WIDTH > _ONE_SORT:
        placed = place_in_order(counts, [*keys, "_i"], ["value"], weight="_times")
    else:
        earlier = Window.partitionBy(*keys, "_i").orderBy("value").rowsBetween(
            Window.unboundedPreceding, -1
        )
        placed = counts.withColumn("before", F.coalesce(F.sum("_times").over(earlier), F.lit(0)))

    names = [
        F.struct(F.lit(i).alias("_i"), F.lit(name).alias("column"), F.col(sizes[i]).alias("n"))
        for i, name in enumerate(columns)
    ]
    facts = brackets.select(*keys, F.inline(F.array(*names)))

    def at(position: Column) -> Column:
        covered = (F.col("before") <= position) & (position < F.col("before") + F.col("_times"))
        return F.max(F.when(covered, F.col("value")))

    middle = (at(F.floor((F.col("n") - 1) / F.lit(2))) + at(F.floor(F.col("n") / F.lit(2)))) / 2
    medians = (
        join_on_keys(placed, facts.drop("column"), [*keys, "_i"])
        .groupBy(*keys, "_i")
        .agg(middle.alias("median"))
    )
    # The sketch bound puts the median inside the bracket; fail loudly rather than lose it.
    missed = F.raise_error(F.lit("median outside its bracket")).cast("double")
    result = (
        join_on_keys(facts, medians, [*keys, "_i"], "left")
        .withColumn("median", F.when(F.col("n") > 0, F.coalesce("median", missed)))
        .drop("_i")
    )
    return result if by else result.drop("_all")
