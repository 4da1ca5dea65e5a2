"""Column and table profiles: one row per column, one row per table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.columns import col
from proofmark.operators.frequent import frequent_values
from proofmark.operators.ordering import exact_medians, median_brackets
from proofmark.plans.wording import PII_NAME_PARTS, TARGET_NAME_PARTS, WARNINGS
from proofmark.workspace import columnar, local_table, settle, settle_rows

# Longer texts are counted by their beginning and SHA-256, so that a shuffle does not move
# whole documents.
_INLINE_TEXT = 64
SAMPLE_SIZE = 5
IDENTIFIER_SHARE = 0.98
HIGH_MISSING = 0.2


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_temporal(field: T.StructField) -> bool:
    kinds = [T.DateType, T.TimestampType, T.TimestampNTZType]
    if hasattr(T, "TimeType"):
        kinds.append(T.TimeType)
    return isinstance(field.dataType, tuple(kinds))


def _contains_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _contains_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_contains_map(f.dataType) for f in data_type.fields)
    return False


def shown(field: T.StructField) -> Column:
    """The column as text: hexadecimal for bytes, JSON for nested values."""
    value, kind = col(field.name), field.dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.MapType) and not _contains_map(kind.keyType) and not _contains_map(kind.valueType):
        return F.to_json(F.array_sort(F.map_entries(value)))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")


def _long_text(field: T.StructField) -> bool:
    return isinstance(
        field.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    )


def comparable(field: T.StructField) -> Column:
    """The column in a form that can be grouped: no maps, and long texts by their first 64
    characters and their digest, so that their order is that of their beginnings."""
    if _long_text(field):
        text = shown(field)
        short = F.concat(F.substring(text, 1, _INLINE_TEXT), F.lit("sha256:"), F.sha2(text, 256))
        return F.when(F.length(text) <= _INLINE_TEXT, text).otherwise(short)
    value, kind = col(field.name), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value + F.lit(0.0).cast(kind)  # -0.0 and 0.0 are one value
    return value


def profile_schema(df: DataFrame) -> DataFrame:
    return local_table(
        df.sparkSession,
        {
            "position": (pa.int32(), list(range(len(df.columns)))),
            "column": (pa.string(), df.columns),
            "type": (pa.string(), [f.dataType.simpleString() for f in df.schema]),
            "nullable": (pa.bool_(), [f.nullable for f in df.schema]),
        },
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def duplicates(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows, and the share of the table."""
    keys = [comparable(f).alias(f"k{i}") for i, f in enumerate(df.schema)]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn(
        "duplicate_rate",
        F.coalesce(F.try_divide(F.col("duplicate_count").cast("double"), F.col("row_count")), F.lit(0.0)),
    )


def _long(wide: DataFrame, names: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One wide aggregate row -> one row per column; fields maps output to prefix."""
    items = [
        F.struct(
            F.lit(name).alias("column"),
            *[F.col(f"{prefix}{i}").alias(out) for out, prefix in fields.items()],
        )
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*items)))


def _missing_aggregates(df: DataFrame) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(col(name).isNull()).alias(f"_m{i}") for i, name in enumerate(df.columns)],
    ]


def _missing_long(wide: DataFrame, names: Sequence[str], empty_rate: float | None) -> DataFrame:
    rate = F.try_divide(F.col("missing_count").cast("double"), F.col("row_count"))
    wide = wide.select("*", *[F.col("_rows").alias(f"_rows{i}") for i in range(len(names))])
    return _long(wide, names, {"missing_count": "_m", "row_count": "_rows"}).withColumn(
        "missing_rate", rate if empty_rate is None else F.coalesce(rate, F.lit(empty_rate))
    )


def missing(df: DataFrame, empty_rate: float | None = 0.0) -> DataFrame:
    """NULLs per column in one scan; ``empty_rate`` is the rate of an empty table."""
    return _missing_long(df.agg(*_missing_aggregates(df)), df.columns, empty_rate)


def _value_groups(df: DataFrame, field: T.StructField) -> DataFrame:
    return (
        df.where(col(field.name).isNotNull())
        .groupBy(comparable(field).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _value_branches(df: DataFrame, columns: Sequence[str] | None) -> list[DataFrame]:
    wanted = set(columns or df.columns)
    return [
        _value_groups(df, field).select(
            F.lit(field.name).alias("column"), F.col("value").cast("string").alias("value"), "n"
        )
        for field in df.schema
        if field.name in wanted
    ]


def frequent_branches(df: DataFrame, fields: Sequence[T.StructField], size: int) -> list[DataFrame]:
    """Like the branches of ``value_counts``, but only with values that can be among the
    ``size`` most frequent of their column."""
    texts = {f.name: comparable(f).cast("string") for f in fields}
    return list(frequent_values(df, texts, size).values())


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) for every distinct non-null value.

    One branch per column: each reads only its own column from a columnar source and
    groups on the native type, so the rows are never multiplied by the column count.
    """
    return reduce(DataFrame.unionAll, _value_branches(columnar(df), columns))


def distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-null values per column (all-NULL columns count 0).

    ``n`` is read although every group has n > 0: the branches then equal those of
    ``value_counts`` and a full profile shuffles each column once for both.
    """
    df, wanted = columnar(df), set(columns or df.columns)
    branches = [
        _value_groups(df, field)
        .agg(F.count_if(F.col("n") > 0).alias("distinct_count"))
        .select(F.lit(field.name).alias("column"), "distinct_count")
        for field in df.schema
        if field.name in wanted
    ]
    return reduce(DataFrame.unionAll, branches)


def distinct_approx(df: DataFrame, buckets: int = 12) -> DataFrame:
    """Sketched distinct counts of all columns in one scan (2^buckets registers each;
    12 gives a relative error near 1.6 %)."""
    wide = df.agg(
        *[
            F.coalesce(
                F.hll_sketch_estimate(
                    F.hll_sketch_agg(F.when(col(f.name).isNotNull(), F.xxhash64(comparable(f))), buckets)
                ),
                F.lit(0),
            ).alias(f"_d{i}")
            for i, f in enumerate(df.schema)
        ]
    )
    return _long(wide, df.columns, {"distinct_count": "_d"})


def samples(
    df: DataFrame, columns: Sequence[str] | None = None, size: int = SAMPLE_SIZE
) -> DataFrame:
    """The most frequent values per column, as text: (column, value, n, position).

    Ties go by the first 64 characters of the value, then by its digest.  Longer texts are
    picked by that key and fetched whole in a second scan.  Exact; values are shuffled only
    where ``frequent_branches`` cannot rule them out.
    """
    df = columnar(df)
    wanted = [f for f in df.schema if f.name in set(columns or df.columns)]
    ranked = _numbered(frequent_branches(df, wanted, size), size)
    return _whole_samples(df, *settle_rows(ranked, "samples"))


def _ranked_values(df: DataFrame, columns: Sequence[str] | None, size: int) -> DataFrame:
    return _numbered(_value_branches(df, columns), size)


def _numbered(branches: Sequence[DataFrame], size: int) -> DataFrame:
    """Top ``size`` per column branch: a bounded heap per task, no sort of all values.
    Only the winners are numbered."""
    order = [F.desc("n"), F.asc("value")]
    best = [branch.orderBy(*order).limit(size) for branch in branches]
    ranking = Window.partitionBy("column").orderBy(*order)
    return reduce(DataFrame.unionAll, best).withColumn("position", F.row_number().over(ranking))


def _whole_samples(df: DataFrame, best: DataFrame, rows: pa.Table | None) -> DataFrame:
    """Put whole texts in place of digests."""
    known = [True] if rows is None else ["sha256:" in str(v) for v in rows["value"].to_pylist()]
    texts = [f for f in df.schema if _long_text(f)]
    if not texts or not any(known):
        return best
    items = [
        F.when(
            F.length(shown(f)) > _INLINE_TEXT,
            F.struct(
                F.lit(f.name).alias("column"), comparable(f).alias("value"), shown(f).alias("text")
            ),
        )
        for f in texts
    ]
    longs = df.select(F.explode(F.array_compact(F.array(*items))).alias("_item")).select("_item.*")
    # At most ``size`` digests per column: small by construction.
    whole = (
        longs.join(F.broadcast(best.select("column", "value")), ["column", "value"], "left_semi")
        .groupBy("column", "value")
        .agg(F.min("text").alias("text"))
    )
    return best.join(whole, ["column", "value"], "left").select(
        "column", F.coalesce("text", "value").alias("value"), "n", "position"
    )


_MOMENTS = {"min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_pop}


def _numeric_aggregates(names: Sequence[str]) -> list[Column]:
    values = [col(n).cast("double") for n in names]
    return [
        *median_brackets(values),
        *[
            aggregate(value).alias(f"_{label}{i}")
            for i, value in enumerate(values)
            for label, aggregate in _MOMENTS.items()
        ],
    ]


def _numeric_long(df: DataFrame, wide: DataFrame, names: Sequence[str]) -> DataFrame:
    values = df.select(*[col(n).cast("double").alias(f"_c{i}") for i, n in enumerate(names)])
    named = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(f"_c{i}"), F.lit(n))])
    medians = exact_medians(
        values, values.columns, brackets=wide.withColumn("_all", F.lit(0))
    ).select(named[F.col("column")].alias("column"), "median")
    moments = _long(wide, names, {label: f"_{label}" for label in _MOMENTS})
    return moments.join(medians, "column", "left")


def _date_aggregates(names: Sequence[str]) -> list[Column]:
    return [
        *[F.min(col(n)).cast("string").alias(f"_start{i}") for i, n in enumerate(names)],
        *[F.max(col(n)).cast("string").alias(f"_end{i}") for i, n in enumerate(names)],
    ]


def numeric_summary(df: DataFrame) -> DataFrame:
    """min, max, mean, population standard deviation and exact median per numeric column."""
    names = [f.name for f in df.schema if is_numeric(f)]
    if not names:
        return _no_rows(df, [*_MOMENTS, "median"], pa.float64())
    return _numeric_long(df, settle(df.agg(*_numeric_aggregates(names)), "numbers"), names)


def date_ranges(df: DataFrame) -> DataFrame:
    """First and last value of every date/time column, as text."""
    names = [f.name for f in df.schema if is_temporal(f)]
    if not names:
        return _no_rows(df, ["start", "end"], pa.string())
    return _long(df.agg(*_date_aggregates(names)), names, {"start": "_start", "end": "_end"})


def _no_rows(df: DataFrame, names: Sequence[str], kind: pa.DataType) -> DataFrame:
    empty = {"column": (pa.string(), []), **{name: (kind, []) for name in names}}
    return local_table(df.sparkSession, empty)


# --- classification of profile rows -------------------------------------------------


def identifier_flag(name: Column, distinct_count: Column, rows: Column) -> Column:
    lowered = F.lower(name)
    share = F.coalesce(F.try_divide(distinct_count.cast("double"), rows), F.lit(0.0))
    return (lowered == "id") | lowered.endswith("_id") | (share >= IDENTIFIER_SHARE)


def _name_has(name: Column, parts: Sequence[str]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def pii_flag(name: Column) -> Column:
    return _name_has(name, PII_NAME_PARTS)


def target_flag(name: Column) -> Column:
    return _name_has(name, TARGET_NAME_PARTS)


def classified(facts: DataFrame) -> DataFrame:
    """Add the three classes to rows with column, distinct_count and row_count."""
    name = F.col("column")
    return facts.withColumns(
        {
            "is_identifier": identifier_flag(name, F.col("distinct_count"), F.col("row_count")),
            "is_pii": pii_flag(name),
            "is_target": target_flag(name),
        }
    )


def column_facts(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Schema, missing, distinct and classes, one row per column."""
    df = columnar(df)
    counted = distinct(df) if exact_distinct else distinct_approx(df)
    return classified(profile_schema(df).join(missing(df), "column").join(counted, "column"))


def _listed(condition: Column, limit: int | None = None) -> Column:
    ordered = F.sort_array(
        F.collect_list(F.when(condition, F.struct("position", "column")))
    )
    return F.transform(ordered, lambda item: item["column"])


def warnings_row(facts: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row: the list of warnings.  ``facts`` has one row per column (bounded by the schema)."""
    lists = facts.agg(
        _listed(F.col("missing_rate") >= HIGH_MISSING).alias("_high"),
        _listed(F.col("is_pii")).alias("pii_columns"),
        _listed(F.col("is_identifier")).alias("identifier_columns"),
        _listed(F.col("is_target")).alias("target_columns"),
        F.count(F.lit(1)).alias("column_count"),
    ).withColumn("_one", F.lit(1))
    table = repeated.withColumn("_one", F.lit(1)).join(lists, "_one").drop("_one")
    text = F.array_compact(
        F.array(
            F.when(F.col("row_count") == 0, F.lit(WARNINGS["empty"])),
            F.when(
                F.col("duplicate_count") > 0,
                F.format_string(WARNINGS["duplicates"], F.col("duplicate_count")),
            ),
            F.when(
                F.size("_high") > 0,
                F.concat(F.lit(WARNINGS["missing"]), F.array_join("_high", ", ")),
            ),
            F.when(
                F.size("pii_columns") > 0,
                F.concat(F.lit(WARNINGS["pii"]), F.array_join("pii_columns", ", ")),
            ),
        )
    )
    return table.withColumn("warnings", text).drop("_high")


@dataclass(frozen=True)
class Profile:
    """``columns``: one row per column; ``table``: one row."""

    columns: DataFrame
    table: DataFrame


def profile(df: DataFrame, exact_distinct: bool = True, sample_size: int = SAMPLE_SIZE) -> Profile:
    """Full profile.  One scan for all plain aggregates, one for the medians, one
    pruned scan per column for distinct values and samples together, one for duplicates."""
    df = columnar(df)
    numbers = [f.name for f in df.schema if is_numeric(f)]
    dates = [f.name for f in df.schema if is_temporal(f)]
    # One row, so the later steps reuse it instead of scanning again.
    wide = settle(
        df.agg(*_missing_aggregates(df), *_numeric_aggregates(numbers), *_date_aggregates(dates)),
        "wide",
    )
    gaps = _missing_long(wide, df.columns, 0.0)
    # Samples and distinct counts in one job: both read the same shuffled value counts.
    # With sketched distinct counts nothing else shuffles the values, so neither do samples.
    ranked = (
        _ranked_values(df, None, sample_size)
        if exact_distinct
        else _numbered(frequent_branches(df, list(df.schema), sample_size), sample_size)
    )
    counted = distinct(df) if exact_distinct else distinct_approx(df)
    values, rows = settle_rows(ranked.unionByName(counted, allowMissingColumns=True), "values")
    counted = values.where(F.col("distinct_count").isNotNull()).select("column", "distinct_count")
    best = values.where(F.col("distinct_count").isNull()).drop("distinct_count")
    facts = classified(profile_schema(df).join(gaps, "column").join(counted, "column"))
    picked = (
        _whole_samples(df, best, rows)
        .groupBy("column")  # at most sample_size rows per column
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("_s"))
        .select("column", F.transform("_s", lambda item: item["value"]).alias("sample_values"))
    )
    columns = facts.join(picked, "column", "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.array().cast("array<string>"))
    )
    columns = (
        columns.join(_numeric_long(df, wide, numbers), "column", "left")
        if numbers
        else columns.withColumns({c: F.lit(None).cast("double") for c in [*_MOMENTS, "median"]})
    )
    columns = (
        columns.join(_long(wide, dates, {"start": "_start", "end": "_end"}), "column", "left")
        if dates
        else columns.withColumns({c: F.lit(None).cast("string") for c in ("start", "end")})
    )
    return Profile(columns, warnings_row(facts, duplicates(df)))


def profile_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of several datasets stacked, with a dataset_id column."""
    parts = [
        profile(table).columns.select(F.lit(name).alias("dataset_id"), "*")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
