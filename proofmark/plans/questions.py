"""Questions to plans as one table job.

A catalog (one row per dataset column) is folded to one row per dataset.  Every question
then meets exactly one catalog row and is resolved by row-local expressions, so a dataset
that attracts a third of all questions costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.columns import col
from proofmark.operators import profile as profiling
from proofmark.operators.ordering import join_on_keys
from proofmark.plans.wording import (
    CATEGORY_NAME_PATTERN,
    COMPARISON_PATTERN,
    COUNT_PATTERN,
    DATE_NAME_PATTERN,
    DIMENSION_WORDS,
    MEAN_PATTERN,
    MONTHS,
    PREFERRED_METRICS,
    QUALITY_PATTERN,
    TOP_PATTERN,
)
from proofmark.workspace import local_table, pin

MIN_FILTER_LENGTH = 3
# Bits of the filter of question words: 4 MB, whatever the number of questions.
FILTER_BITS = 1 << 25


def normalize_text(text: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


# --- catalog ---------------------------------------------------------------------------


def schema_catalog(dataset_id: str, df: DataFrame) -> DataFrame:
    """Catalog rows from the schema alone: no date range, no data read."""
    width = len(df.columns)
    return local_table(
        df.sparkSession,
        {
            "dataset_id": (pa.string(), [dataset_id] * width),
            "position": (pa.int32(), list(range(width))),
            "column": (pa.string(), df.columns),
            "is_numeric": (pa.bool_(), [profiling.is_numeric(f) for f in df.schema]),
            "is_date": (pa.bool_(), [profiling.is_temporal(f) for f in df.schema]),
            "date_end": (pa.string(), [None] * width),
        },
    )


def question_catalog(dataset_id: str, df: DataFrame) -> DataFrame:
    """Catalog with the last date of every date column, which the resolver needs."""
    base = schema_catalog(dataset_id, df)
    if any(profiling.is_temporal(f) for f in df.schema):
        ends = profiling.date_ranges(df).select("column", F.col("end").alias("_end"))
        base = base.join(ends, "column", "left").withColumn("date_end", F.col("_end")).drop("_end")
    return base


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def value_index(dataset_id: str, df: DataFrame) -> DataFrame:
    """All distinct text values a question may name: (dataset_id, position, column, value,
    pattern, words, width).  ``words`` is the join key: the words of the value, in order."""
    texts = [(i, f.name) for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)]
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), col(n).alias("value"))
        for i, n in texts
    ]
    none = F.array().cast("array<struct<position:int,column:string,value:string>>")
    values = (
        df.select(F.inline(F.array(*items) if items else none))
        .where(F.length("value") >= MIN_FILTER_LENGTH)
        .distinct()
    )
    lowered = F.lower("value")
    # (?U): word boundaries of all alphabets, as in the contract.
    escaped = F.regexp_replace(lowered, r"([^\p{L}\p{N}\s])", r"\\$1")
    return values.select(
        F.lit(dataset_id).alias("dataset_id"),
        "position",
        "column",
        "value",
        F.concat(F.lit(r"(?U)\b"), escaped, F.lit(r"\b")).alias("pattern"),
        F.array_join(_words(lowered), " ").alias("words"),
        F.size(_words(lowered)).alias("width"),
    ).where(F.col("width") > 0)


def fold_catalog(
    catalog: DataFrame, extra_dimension_words: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """One row per dataset with everything a question needs."""
    rows = catalog.groupBy("dataset_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("position", "column", "is_numeric", "is_date", "date_end")
            )
        ).alias("_cols")
    )
    named = F.transform(
        "_cols",
        lambda c: F.struct(
            c["column"].alias("name"),
            normalize_text(c["column"]).alias("norm"),
            c["is_numeric"].alias("is_numeric"),
            c["is_date"].alias("is_date"),
            c["date_end"].alias("date_end"),
        ),
    )
    rows = rows.withColumn("_named", named).withColumn(
        "numeric", F.filter("_named", lambda c: c["is_numeric"])
    )
    preferred = F.flatten(
        F.transform(
            F.array(*[F.lit(p) for p in PREFERRED_METRICS]),
            lambda p: F.filter("numeric", lambda n: F.contains(n["norm"], p)),
        )
    )
    words = F.array(
        *[
            F.struct(F.lit(word).alias("word"), F.lit(meaning).alias("meaning"))
            for word, meaning in (*DIMENSION_WORDS, *extra_dimension_words)
        ]
    )
    dimension_words = F.filter(
        F.transform(
            words,
            lambda w: F.struct(
                w["word"].alias("word"),
                _first(
                    F.filter(
                        "_named",
                        lambda c: F.contains(c["norm"], w["meaning"]) | F.contains(c["norm"], w["word"]),
                    )
                )["name"].alias("column"),
            ),
        ),
        lambda w: w["column"].isNotNull(),
    )
    dated = F.coalesce(
        _first(F.filter("_named", lambda c: c["is_date"])),
        _first(F.filter("_named", lambda c: F.lower(c["name"]).rlike(DATE_NAME_PATTERN))),
    )
    return rows.select(
        "dataset_id",
        F.transform("_named", lambda c: c["name"]).alias("names"),
        F.transform(
            "numeric", lambda c: F.struct(c["name"].alias("name"), c["norm"].alias("norm"))
        ).alias("numeric"),
        F.coalesce(_first(preferred)["name"], _first(F.col("numeric"))["name"]).alias("default_metric"),
        dimension_words.alias("dimension_words"),
        dated["name"].alias("date_column"),
        F.regexp_extract(F.coalesce(dated["date_end"], F.lit("")), r"^(\d{4})", 1)
        .try_cast("int")
        .alias("year"),
        _first(
            F.filter("_named", lambda c: F.lower(c["name"]).rlike(CATEGORY_NAME_PATTERN))
        )["name"].alias("category_column"),
    )


# --- resolvers over question x folded catalog (columns of ``with_catalog``) ---------------


def resolve_metric() -> Column:
    named = F.filter("numeric", lambda n: F.contains(F.col("normalized"), n["norm"]))
    return F.coalesce(_first(named)["name"], F.col("default_metric"))


def resolve_dimension() -> Column:
    named = F.filter("dimension_words", lambda w: F.contains(F.col("lowered"), w["word"]))
    return _first(named)["column"]


def _bit(dataset_id: Column, head: Column) -> Column:
    """The place of a text in the filter, from 1."""
    return F.pmod(F.xxhash64(dataset_id, head), F.lit(FILTER_BITS)) + 1


def question_bits(asked: DataFrame) -> DataFrame:
    """(bucket, bits): a Bloom filter of all words and pairs of neighbouring words of the
    questions, in at most FILTER_BITS / 32768 rows of 4 KB."""
    pairs = F.transform("_words", lambda _, i: F.array_join(F.slice("_words", i + 1, 2), " "))
    heads = F.explode(F.array_distinct(F.concat("_words", pairs))).alias("_head")
    place = _bit(F.col("dataset_id"), F.col("_head"))
    return (
        asked.select("dataset_id", heads)
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )


def nameable(values: DataFrame, asked: DataFrame) -> DataFrame:
    """The values that a question may name: not longer than the longest question, and the
    first two words (or the only one) occur in a question of their dataset.

    The limit on the length is applied below the shuffle of distinct values, so long texts
    are dropped where they are read.  The filter may keep a value too many, never one too few.
    """
    longest = asked.agg(F.max(F.length("_lowered"))).first()[0] or 0
    head = F.array_join(F.slice(F.split("words", " "), 1, 2), " ")
    place = _bit(F.col("dataset_id"), head)
    short = values.where(F.length(F.lower("value")) <= longest).withColumns(
        {"_bucket": F.bitmap_bucket_number(place), "_position": F.bitmap_bit_position(place)}
    )
    byte = F.substring("bits", (F.col("_position") / 8).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("_position") % 8).cast("int"))
    # Bounded by FILTER_BITS, hence small by construction.
    bits = F.broadcast(question_bits(asked))
    found = short.join(bits, (F.col("_bucket") == F.col("bucket")) & (hit == 1), "left_semi")
    return found.drop("_bucket", "_position")


def value_filters(questions: DataFrame, values: DataFrame) -> DataFrame:
    """(dataset_id, text, filters): per column the value that a question names in full.

    Equal questions are resolved once.  Values that no question can name are dropped before
    anything is written (``nameable``).  The word sequences of the questions, of the widths
    that occur among the values left, are joined to the words of these; the pattern then checks
    the exact spelling.  Of several values the longest counts, then the first in order.
    """
    asked = (
        questions.select("dataset_id", "text")
        .distinct()
        .withColumn("_lowered", F.lower("text"))
        .withColumn("_words", _words(F.col("_lowered")))
    )
    values = pin(nameable(values, asked), "values")
    widths = sorted(r[0] for r in values.select("width").distinct().collect())
    last = F.size("_words") - F.col("width")
    sequences = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice("_words", i + 1, F.col("width")), " "),
    )
    named = (
        asked.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>")))
        .where(last >= 0)
        .select("dataset_id", "text", "_lowered", F.explode(F.array_distinct(sequences)).alias("words"))
        .join(values, ["dataset_id", "words"])
        .where(F.rlike("_lowered", F.col("pattern")))
    )
    best = F.min(F.struct((-F.length("value")).alias("_length"), "value"))["value"]
    return (
        named.groupBy("dataset_id", "text", "position", "column")
        .agg(best.alias("value"))
        .groupBy("dataset_id", "text")
        .agg(F.sort_array(F.collect_list(F.struct("position", "column", "value"))).alias("_f"))
        .select(
            "dataset_id",
            "text",
            F.transform(
                "_f", lambda f: F.struct(f["column"].alias("column"), f["value"].alias("value"))
            ).alias("filters"),
        )
    )


def with_filters(questions: DataFrame, values: DataFrame | None) -> DataFrame:
    """The questions with their ``filters``, none where there are no values."""
    none = F.array().cast("array<struct<column:string,value:string>>")
    if values is None:
        return questions.withColumn("filters", none)
    found = pin(value_filters(questions, values), "filters")
    joined = join_on_keys(questions, found, ["dataset_id", "text"], "left")
    return joined.withColumn("filters", F.coalesce("filters", none))


def resolve_month(lowered: Column) -> Column:
    """Latest month named in the lower-case question, or NULL; one pass over the text."""
    pattern = r"\b(" + "|".join(MONTHS) + r")\b"
    numbers = F.create_map(*[x for name, number in MONTHS.items() for x in (F.lit(name), F.lit(number))])
    found = F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1))
    return F.array_max(F.transform(found, lambda word: F.try_element_at(numbers, word)))


def classify_intent(
    lowered: Column, metric: Column, dimension: Column, date_column: Column, month: Column
) -> Column:
    return (
        F.when(F.length(F.trim(lowered)) == 0, "blank")
        .when(lowered.rlike(QUALITY_PATTERN), "quality")
        .when(
            date_column.isNotNull()
            & metric.isNotNull()
            & month.isNotNull()
            & lowered.rlike(COMPARISON_PATTERN),
            "comparison",
        )
        .when(lowered.rlike(TOP_PATTERN) & dimension.isNotNull() & metric.isNotNull(), "top")
        .when(dimension.isNotNull() & metric.isNotNull(), "grouped")
        .when(lowered.rlike(COUNT_PATTERN), "count")
        .when(metric.isNotNull() & lowered.rlike(MEAN_PATTERN), "average")
        .when(metric.isNotNull(), "total")
        .otherwise("unanswerable")
    )


def required_columns(*columns: Column) -> Column:
    """Ordered distinct non-null names."""
    return F.array_distinct(F.array_compact(F.concat(*columns)))


def with_catalog(questions: DataFrame, folded: DataFrame) -> DataFrame:
    """Questions (dataset_id, text, ...) joined to their folded catalog row.

    No hint: Spark broadcasts the catalog when its size is small and otherwise
    shuffles, where adaptive execution splits datasets with very many questions.
    The text is normalised below the join, once per question instead of once per column.
    """
    text = F.col("text")
    prepared = questions.withColumns({"lowered": F.lower(text), "normalized": normalize_text(text)})
    return prepared.join(folded, "dataset_id", "left")


def plan_questions(
    questions: DataFrame, folded: DataFrame, values: DataFrame | None = None
) -> DataFrame:
    """One plan per question: intent, resolved columns, filters, months, evidence keys.

    ``values`` (``value_index``) holds what filters can name; without it there are none.
    """
    resolved = with_catalog(with_filters(questions, values), folded).withColumns(
        {
            "metric": resolve_metric(),
            "dimension": resolve_dimension(),
            "current_month": resolve_month(F.col("lowered")),
        }
    )
    resolved = resolved.withColumn(
        "intent",
        classify_intent(
            F.col("lowered"), F.col("metric"), F.col("dimension"), F.col("date_column"), F.col("current_month")
        ),
    )
    comparison = F.col("intent") == "comparison"
    breakdown = F.coalesce("dimension", F.when(comparison, F.col("category_column")))
    resolved = resolved.withColumn("breakdown", breakdown)
    filter_names = F.transform("filters", lambda f: f["column"])
    quality, counting = F.col("intent") == "quality", F.col("intent") == "count"
    return resolved.select(
        *[F.col(c) for c in questions.columns],
        "intent",
        F.when(quality, "quality").when(comparison, "comparison").otherwise("aggregate").alias("answer_type"),
        F.when(quality, F.array(F.lit("missing_values")))
        .when(comparison & F.col("breakdown").isNotNull(), F.array(F.lit("monthly_comparison"), F.lit("segment_contribution")))
        .when(comparison, F.array(F.lit("monthly_comparison")))
        .when(F.col("intent") == "top", F.array(F.lit("top_segments")))
        .when(F.col("intent") == "grouped", F.array(F.lit("grouped_aggregate")))
        .when(F.col("intent").isin("count", "average", "total"), F.array(F.lit("aggregate")))
        .otherwise(F.array().cast("array<string>"))
        .alias("evidence_keys"),
        "metric",
        "breakdown",
        "date_column",
        "year",
        "current_month",
        F.when(F.col("current_month") == 1, 12).otherwise(F.col("current_month") - 1).alias("previous_month"),
        "filters",
        F.when(quality, F.col("names"))
        .when(comparison, required_columns(F.array("date_column", "metric", "breakdown"), filter_names))
        .when(counting, required_columns(filter_names))
        .otherwise(required_columns(F.array("metric", "breakdown"), filter_names))
        .alias("required_columns"),
    )
