"""Operator 7: document fingerprints as threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed share of the hash range, so its size follows
the text, sketches of parts can be merged by union, and the containment of a short text in a
very long one can be estimated.  A text with few hashes below the threshold keeps its 16
smallest ones instead; ``cover`` is the value up to which a sketch is complete, and two
sketches are compared up to the smaller cover.

The likeness of two sketches is the containment of the smaller one in the larger one.

The next document of each one, in order of ids, is found without a window over the whole
table: documents go to slices of the id range, and the first document of each slice also
visits the end of the slice before it.  Only DataFrame functions are used.

Cases: null texts count as empty; wordless texts have an empty sketch, alike (1.0) to each
other and unlike (0.0) all others; a text of fewer words than a shingle is one shingle;
null ids come first, rows with equal ids are ordered by a hash of their texts; a single
document is its own next one; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmark.registry.base import table
from proofmark.workspace import local_table

SHINGLE = 3
# One hash in 2**SHIFT is kept; short texts keep their LEAST smallest ones.
SHIFT = 4
LEAST = 16

_FIRST, _LAST = -(2**63), 2**63 - 1


def _shingle_hashes(words: str, width: int) -> Column:
    """Hashes of the word runs in an array column of word hashes."""
    count = F.size(words) - (width - 1)
    runs = F.slice(words, F.lit(1), F.greatest(count, F.lit(0)))
    for i in range(1, width):
        runs = F.zip_with(
            runs,
            F.slice(words, F.lit(i + 1), F.greatest(count, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(count > 0, runs).otherwise(whole)


def with_sketch(
    documents: DataFrame, text: str, name: str, width: int = SHINGLE, shift: int = SHIFT
) -> DataFrame:
    """Add ``name``: struct(hashes ascending, cover) of a non-null text column.

    The steps are separate projections, so that none is evaluated twice.
    """
    limit = _FIRST + 2 ** (64 - shift)
    words = F.transform(
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)
    )
    low = F.sort_array(F.array_distinct(F.filter("_all", lambda x: x < limit)))
    smallest = F.sort_array(F.array_distinct("_all"))
    few = F.size("_low") < LEAST
    fewest = F.slice(F.col("_some"), 1, LEAST)
    cover = (
        F.when(~few, F.lit(limit - 1))
        .when(F.size("_some") <= LEAST, F.lit(_LAST))
        .otherwise(F.get("_some", F.lit(LEAST - 1)))
    )
    return (
        documents.withColumn("_words", words)
        .withColumn("_all", _shingle_hashes("_words", width))
        .drop("_words")
        .withColumn("_low", low)
        .withColumn("_some", F.when(few, smallest))
        .drop("_all")
        .withColumn(
            name, F.struct(F.when(few, fewest).otherwise(F.col("_low")).alias("hashes"), cover.alias("cover"))
        )
        .drop("_low", "_some")
    )


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts taken together (without the shingles across their border)."""
    cover = F.least(a["cover"], b["cover"])
    both = F.sort_array(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(F.filter(both, lambda x: x <= cover).alias("hashes"), cover.alias("cover"))


def likeness(a: str, b: str) -> Column:
    """Containment of the smaller sketch in the larger one, 0 to 1."""
    cover = F.least(F.col(f"{a}.cover"), F.col(f"{b}.cover"))
    kept_a = F.filter(F.col(f"{a}.hashes"), lambda x: x <= cover)
    kept_b = F.filter(F.col(f"{b}.hashes"), lambda x: x <= cover)
    smaller = F.least(F.size(kept_a), F.size(kept_b))
    both_empty = (F.size(f"{a}.hashes") == 0) & (F.size(f"{b}.hashes") == 0)
    return (
        F.when(both_empty, F.lit(1.0))
        .when(smaller == 0, F.lit(0.0))
        .otherwise(F.size(F.array_intersect(kept_a, kept_b)) / smaller)
    )


def shown(sketch: str) -> Column:
    """The sketch as text: its cover and its hashes in hexadecimal."""
    hashes = F.transform(F.col(f"{sketch}.hashes"), lambda x: F.lower(F.hex(x)))
    return F.concat(F.lower(F.hex(F.col(f"{sketch}.cover"))), F.lit(":"), F.array_join(hashes, ","))


def _slices(documents: DataFrame, order: str, count: int) -> Column:
    """Number of the id slice: a fixed expression of the id, by sampled bounds.

    The bounds are searched in two steps, so a row costs about 2 * sqrt(count).
    """
    shares = [i / count for i in range(1, count)]
    found = documents.agg(F.percentile_approx(order, shares, 20 * count)).first()[0] or []
    bounds = sorted(set(found))
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[0]]
    long_array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    part = F.size(F.filter(long_array([p[-1] for p in parts]), lambda b: b < F.col(order)))
    inner = F.get(F.array(*[long_array(p) for p in parts]), part)
    within = F.size(F.filter(F.coalesce(inner, long_array([])), lambda b: b < F.col(order)))
    return part * step + within


def with_next(documents: DataFrame, key: str, text: str, carried: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the next document by ascending ``key`` for each carried column."""
    spark = documents.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.withColumns(
        {
            "_order": F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)),
            "_tie": F.xxhash64(text),
        }
    )
    slices = _slices(ordered.select("_order"), "_order", count)
    sliced = ordered.withColumn("_slice", slices)
    # One row per slice: as many as there are bounds.
    firsts = sorted(
        (row["_slice"], row["f"]["_order"], row["f"]["_tie"])
        for row in sliced.groupBy("_slice").agg(F.min(F.struct("_order", "_tie")).alias("f")).collect()
    )
    visits = {
        "_order": (pa.int64(), [f[1] for f in firsts]),
        "_tie": (pa.int64(), [f[2] for f in firsts]),
        "_to": (pa.int32(), [firsts[i - 1][0] for i in range(len(firsts))]),
        "_wrap": (pa.int32(), [int(i == 0) for i in range(len(firsts))]),
    }
    guests = F.broadcast(local_table(spark, visits))
    own = F.struct(F.col("_slice"), F.lit(0).alias("_wrap"), F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_to").alias("_slice"), F.col("_wrap"), F.lit(True).alias("_guest"))
    placed = sliced.join(guests, ["_order", "_tie"], "left").withColumn(
        "_place",
        F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))),
    )
    window = Window.partitionBy("_at").orderBy("_last", "_order", "_guest", "_tie")
    columns = [F.col(c) for c in documents.columns]
    return (
        placed.select(
            *columns, "_order", "_tie", F.col("_place._slice").alias("_at"),
            F.col("_place._wrap").alias("_last"), F.col("_place._guest").alias("_guest"),
        )
        .withColumns({f"next_{c}": F.lead(c).over(window) for c in carried})
        .where(~F.col("_guest"))
        .drop("_order", "_tie", "_at", "_last", "_guest")
    )


def fingerprint_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against itself with its last quarter replaced by the next one's start."""
    narrow = documents.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    own = with_sketch(narrow, "text", "sketch")
    paired = with_next(own, "doc_id", "text", ["text", "sketch"])
    n = F.char_length("text")
    quarter = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - quarter),
        F.substring(F.col("next_text"), F.lit(1), quarter),
    )
    changed = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch"
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_sketch(changed, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("sketch").alias("fingerprint"),
        shown("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )


def op7_scaled_sketch(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprint_edits(table(spark, directory, "documents"))
