"""Connected components by alternating large-star and small-star.

Every step maps each node to the least node it knows and rewires its neighbours, so a hub
is rewired by a join, never gathered.  The least nodes are written before they are joined, so
that the join can split the rows of a hub.  Each step is written to the shared folder, which
cuts the lineage and lets lost executors resume from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.workspace import pin


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to the least of its neighbourhood."""
    turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    # One shuffle, not a union of two, so that the join below can split it.
    both = edges.select(F.inline(F.array(F.struct("u", "v"), turned)))
    least = pin(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("w")), "least")
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("w").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pin(down.groupBy("u").agg(F.min("v").alias("w")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return (
        moved.where(F.col("u") != F.col("v"))
        .unionByName(least.select("u", F.col("w").alias("v")))
        .distinct()
    )


def _state(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))
    ).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node.

    Loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    edges = pin(edges.where(F.col("u") != F.col("v")).select("u", "v"), "edges")
    before = None
    while True:
        edges = pin(_small_star(pin(_large_star(edges), "stars")), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pin(ends.unionByName(roots), "components")
