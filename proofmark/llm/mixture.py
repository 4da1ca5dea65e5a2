"""Operator 3: mixing sources to target weights by capped water-filling.

Every source has a weight.  The mix shall hold ``share`` times all words; each source gets
its part by weight, but at most ``epochs`` times its own words, and what is cut off is
given to the others by weight until nobody is above the limit.  A source's target then
means some whole passes over its documents and a fraction of one more.  The fraction is
taken in a seeded order of the documents: the documents up to a cut, so that the words
taken come within half a document of the target.

Only DataFrame functions are used.  The cumulative word counts inside a source go through
range slices (``place_in_order``), so a hot source is spread over many tasks, and what is
joined back to the documents is one cut per source.

Cases: a null source is a source of its own and comes last; null and empty texts have size
0 and are never read as words; rows repeating source, id and size are taken alike; an empty
table gives an empty result; a table without words gives targets of 0.  Columns of the
input that carry the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators.ordering import join_on_keys, place_in_order
from proofmark.registry.base import table
from proofmark.workspace import pin

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 1
WORD = r"[^\x20\x09-\x0D]+"

_RESULT = ("size", "source_size", "target", "taken", "repeats")


def word_count(text: Column | str) -> Column:
    """Number of words of a text; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, share: float, epochs: int) -> float | None:
    """The level at which sum(min(level * weight, epochs * size)) = share * sum(size).

    Starts with all sources free.  Those at their limit are clamped and the rest of the
    amount is divided among the others; the level only rises, so this ends.  Each round is
    one aggregate; ``None`` means that every source is at its limit.
    """
    limit = F.col("source_size") * F.lit(epochs)
    amount = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = limit <= F.lit(level) * F.col("weight")
        taken, weight = sources.agg(
            F.coalesce(F.sum(F.when(clamped, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
        ).first()
        if not weight:
            return None
        raised = (share * amount - taken) / weight
        if raised <= level:
            return level
        level = raised


def _order(key: str) -> Column:
    """Seeded position of a document in its source; equal in every engine with MD5."""
    return F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def mix(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
) -> DataFrame:
    """The documents with size, source_size, target, repeats and taken = repeats * size.

    ``weights`` go to the sources in order of their names, again from the start when used up.
    """
    sized = pin(
        documents.select(
            F.col(source).alias("_source"), F.col(key).alias("_key"), word_count(text).alias("size")
        ),
        "sizes",
    )
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    numbered = place_in_order(
        totals.withColumn("_last", F.col("_source").isNull()), (), ["_last", "_source"]
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int")
    )
    sources = pin(numbered.select("_source", "source_size", weight.alias("weight")), "sources")

    level = water_level(sources, share, epochs)
    limit = (F.col("source_size") * F.lit(epochs)).cast("double")
    target = limit if level is None else F.least(limit, F.lit(level) * F.col("weight"))
    targets = sources.withColumn("target", target).withColumn(
        "_passes",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(
            F.lit(0)
        ),
    ).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))

    alike = (
        sized.withColumn("_order", _order("_key"))
        .groupBy("_source", "_order", "_key", "size")
        .agg(F.sum("size").alias("_words"))
    )
    placed = place_in_order(alike, ["_source"], ["_order", "_key", "size"], weight="_words")
    # Without a rest nothing is taken again, not even texts without words.
    inside = (F.col("_rest") > 0) & (F.col("before") + F.col("_words") / F.lit(2) <= F.col("_rest"))
    cuts = (
        join_on_keys(placed, targets.select("_source", "_rest"), ["_source"])
        .where(inside)
        .groupBy("_source")
        .agg(F.max(F.struct("_order", "_key", "size")).alias("_cut"))
    )
    decided = pin(
        join_on_keys(targets, cuts, ["_source"], "left").select(
            "_source", "source_size", "target", "_passes", "_cut"
        ),
        "targets",
    )
    own = documents.drop(*[c for c in documents.columns if c in _RESULT]).withColumns(
        {"_source": F.col(source), "_key": F.col(key), "size": word_count(text)}
    )
    extra = F.struct(_order("_key").alias("_order"), "_key", "size") <= F.col("_cut")
    repeats = F.col("_passes") + F.when(F.coalesce(extra, F.lit(False)), F.lit(1)).otherwise(0)
    return (
        join_on_keys(own, decided, ["_source"])
        .withColumn("repeats", repeats.cast("int"))
        .withColumn("taken", F.col("repeats") * F.col("size"))
        .drop("_source", "_key", "_passes", "_cut")
    )


def op3_source_mixture(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "source", "text")
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    2 * source_size AS most, sum(source_size) OVER () * 1.5::DOUBLE AS amount FROM s),
r AS (SELECT *, most / weight AS ratio,
    coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1
      PRECEDING), 0) AS clamped,
    sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED
      FOLLOWING) AS others FROM w),
l AS (SELECT (amount - clamped) / others AS level FROM r
  WHERE most > (amount - clamped) / others * weight ORDER BY ratio, source LIMIT 1),
t AS (SELECT source, source_size, least(most::DOUBLE, level * weight) AS target
  FROM w CROSS JOIN l),
p AS (SELECT d.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('1|' || d.doc_id), d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN before + size / 2 <= target - passes * source_size THEN 1 ELSE 0 END)
  )::BIGINT AS taken
FROM p
"""
