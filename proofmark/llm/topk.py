"""Operator 4: exact top-k inner products by a pivot-distance index.

Inner products become distances: with M the largest squared norm, every vector gets one
more component that lifts its squared norm to M, queries get 0 there, and then
``|q - v|^2 = |q|^2 + M - 2 q.v``.  So the highest scores are the nearest vectors.

Index: each vector is keyed by its nearest pivot and its distance to it; the vectors of a
pivot, in order of distance, form annuli of at most ``ANNULUS`` rows.  Equal vectors simply
fill several annuli, so a hot vector spreads over many tasks.

Search: by the triangle inequality no vector of the annulus [lo, hi] of pivot p is nearer to
q than max(lo - d(q, p), d(q, p) - hi).  Every query first visits the few annuli with the
least bounds; its k-th score there is a floor.  Then it visits exactly the annuli whose
bound does not rule out that floor.  Both rounds send queries in portions to annuli, so a
task holds one annulus and one portion.

Pivots are a bounded sample (``PIVOTS``); they only steer the pruning, never the results.

Cases: vectors that are null, or hold a null or non-finite component, take no part; shorter
vectors count as filled up with zeros; rows without id take no part; candidates with the
query's id are left out; ties go to the smaller id; fewer candidates than k give fewer rows;
an empty table gives an empty result.  Scores must fit a long.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.operators.ordering import place_in_order
from proofmark.registry.base import table
from proofmark.workspace import pin

K = 5
SCALE = 256
PIVOTS = 64
# Rows of an annulus, queries handed to an annulus at once.
ANNULUS = 2_048
PORTION = 1_024
# Annuli visited first, to find a floor of the k-th score.
FIRST = 4
# Beyond this, products are added in integers instead of doubles.
_EXACT = 2**53
# Distances are rounded; bounds give way by this share.
_SLACK = 1e-9


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): the usable vectors with every component floor(scale * x)."""
    x = F.col(vector)
    ok = F.col(key).isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    )
    return vectors.where(ok).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"),
    )


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows of one integer matrix, filled up with zeros."""
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    if (sizes == width).all() and len(sizes):
        return np.concatenate(list(column)).reshape(len(sizes), width).astype(np.int64)
    found = np.zeros((len(sizes), width), np.int64)
    for i, v in enumerate(column):
        found[i, : len(v)] = v
    return found


def _distances(rows: np.ndarray, lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances in the lifted space; pivots carry the extra component in the last column."""
    whole = np.concatenate([rows.astype(np.float64), lifted[:, None]], axis=1)
    squares = (whole**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * whole @ pivots.T, 0))


def _keyed(pivots: np.ndarray, width: int, most: float):
    """Batches (id, v) with the nearest pivot and the distance to it."""

    def run(batches):
        for frame in batches:
            rows = _matrix(frame["v"], width)
            lift = np.sqrt(np.maximum(most - (rows.astype(np.float64) ** 2).sum(axis=1), 0))
            far = _distances(rows, lift, pivots)
            near = far.argmin(axis=1)
            yield frame.assign(pivot=near.astype(np.int32), distance=far[range(len(near)), near])

    return run


def _planned(pivots: np.ndarray, rings: pd.DataFrame, width: int, most: float, floors: bool):
    """Batches of queries with the annuli they visit.

    Without floors: the FIRST least bounds.  With floors: all others that may still hold a
    vector reaching the floor.
    """
    pivot, low, high, ring = (rings[c].to_numpy() for c in ("pivot", "low", "high", "ring"))

    def run(batches):
        for frame in batches:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                rows = _matrix(part["v"], width)
                to = _distances(rows, np.zeros(len(rows)), pivots)[:, pivot]
                bound = np.maximum(np.maximum(low - to, to - high), 0) * (1 - _SLACK)
                order = np.argsort(bound, axis=1, kind="stable")[:, :FIRST]
                visits = np.zeros(bound.shape, bool)
                np.put_along_axis(visits, order, True, axis=1)
                if floors:
                    norms = (rows.astype(np.float64) ** 2).sum(axis=1)
                    reach = (norms[:, None] + most - bound**2) / 2 * (1 + _SLACK) + 1
                    floor = part["floor"].fillna(-np.inf).to_numpy(np.float64)
                    visits = ~visits & (reach >= floor[:, None])
                at, of = np.nonzero(visits)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy()[at],
                        "v": part["v"].to_numpy()[at],
                        "ring": ring[of],
                    }
                )

    return run


def _scored(width: int, k: int, exact: bool):
    """The k best of one annulus for each query of one portion."""

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        rows = rows.sort_values("id", kind="stable")
        ids, asked = rows["id"].to_numpy(), queries["id"].to_numpy()
        left, right = _matrix(queries["v"], width), _matrix(rows["v"], width)
        if exact:
            scores = np.rint(left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
        else:
            scores = left @ right.T
        # Own rows sink to the end; a stable sort keeps smaller ids first among ties.
        own = asked[:, None] == ids[None, :]
        ranked = np.where(own, -np.iinfo(np.int64).max, scores)
        take = min(k, len(ids))
        if len(ids) > 4 * k:
            least = -np.partition(-ranked, take - 1, axis=1)[:, take - 1]
            at, of = np.nonzero((ranked >= least[:, None]) & ~own)
        else:
            at, of = np.nonzero(~own)
        # All that tie with the k-th come along; keep k per query, smaller ids first.
        order = np.lexsort((ids[of], -ranked[at, of], at))
        at, of = at[order], of[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, of = at[place < k], of[place < k]
        return pd.DataFrame({"query_id": asked[at], "vec_id": ids[of], "score": scores[at, of]})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """Per query the k best (score, vec_id), as an array; partial results stay small."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visit(
    visits: DataFrame, index: DataFrame, width: int, k: int, exact: bool
) -> DataFrame:
    portion = F.pmod(F.xxhash64("id"), F.lit(2**20))
    counted = visits.withColumn("_p", portion)
    # A ring asked by many queries meets them in portions; the ring's rows are repeated.
    asked = visits.groupBy("ring").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(PORTION)).cast("int").alias("parts")
    )
    queries = counted.join(asked, "ring").select(
        "ring", F.pmod("_p", "parts").cast("int").alias("part"), "id", "v"
    )
    rows = index.join(asked, "ring").select(
        "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v"
    )
    return (
        queries.groupBy("ring", "part")
        .cogroup(rows.groupBy("ring", "part"))
        .applyInPandas(_scored(width, k, exact), "query_id long, vec_id long, score long")
    )


def top_inner_products(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for every query row."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = whole_vectors(vectors, key, vector, scale)
    asked = whole_vectors(queries, key, vector, scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    facts = rows.unionByName(asked).agg(
        F.max(square), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    ).first()
    if facts[0] is None or asked.isEmpty():
        return empty
    most, width, largest = facts[0] * (1 + _SLACK), max(1, facts[1]), facts[2] or 0
    exact = width * float(largest) ** 2 < _EXACT

    # Bounded sample, at most ``pivots`` rows.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    centre = _matrix(sample["v"], width)
    lift = np.sqrt(np.maximum(most - (centre.astype(np.float64) ** 2).sum(axis=1), 0))
    points = np.concatenate([centre.astype(np.float64), lift[:, None]], axis=1)

    keyed = rows.mapInPandas(
        _keyed(points, width, most), "id long, v array<long>, pivot int, distance double"
    )
    placed = place_in_order(keyed, ["pivot"], ["distance", "id"])
    index = pin(
        placed.withColumn(
            "ring",
            F.shiftleft(F.col("pivot").cast("long"), 40) + F.floor(F.col("before") / F.lit(ANNULUS)),
        ).select("ring", "pivot", "id", "v", "distance"),
        "index",
    )
    # One row per annulus: the directory of the index, 1/ANNULUS of the rows.
    rings = (
        index.groupBy("ring", "pivot")
        .agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
        .toPandas()
        .sort_values("ring")
    )
    rings["low"] *= 1 - _SLACK
    rings["high"] *= 1 + _SLACK

    asked = pin(asked.repartition(F.xxhash64("id")), "queries")
    plan = "id long, v array<long>, ring long"
    first = pin(
        asked.mapInPandas(_planned(points, rings, width, most, False), plan), "visits"
    )
    seen = pin(_best(_visit(first, index, width, k, exact), k), "seen")
    floors = seen.where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("floor")
    )
    rest = pin(
        asked.join(floors, "id", "left").mapInPandas(
            _planned(points, rings, width, most, True), plan
        ),
        "visits",
    )
    more = _visit(rest, index, width, k, exact)
    return _best(seen.drop("rank").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, directory: str) -> DataFrame:
    embeddings = table(spark, directory, "embeddings").select("vec_id", "embedding")
    return top_inner_products(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))


OP4_SQL = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
