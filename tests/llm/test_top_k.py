import math

import numpy as np
import pytest

from proofmark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def by_hand(rows, queries, k):
    usable = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    known = dict(usable)
    found = set()
    for q in queries:
        if q in known:
            scores = sorted(
                (-sum(a * b for a, b in zip(known[q], v)), i) for i, v in usable if i != q
            )[:k]
            found |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return found


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=8).astype(np.float32)]) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(150)]  # a hot vector: ties
    rows += [(800, None), (801, [1.0, None]), (802, [float("nan")] * 8), (803, [float("inf")] * 8)]
    rows += [(804, []), (805, [2.0, -1.0]), (None, [1.0] * 8), (850, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("ring", [16, 2048])
def test_equals_all_pairs(spark, rows, ring, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", ring)
    monkeypatch.setattr(topk, "PORTION", 7)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = topk.top_inner_products(df, df.where("vec_id % 50 = 0"), pivots=8).collect()
    wanted = by_hand(rows, range(0, 900, 50), 5)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == wanted
    assert len(found) == len(wanted)


def test_few_rows_large_values_and_empty_tables(spark):
    few = [(0, [1e6, 2e6]), (50, [3e6, 1.5]), (7, [-1e6, 4e5])]
    df = spark.createDataFrame([(*r, "x") for r in few], SCHEMA)
    found = topk.top_inner_products(df, df.where("vec_id % 50 = 0")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == by_hand(few, (0, 50), 5)
    assert topk.top_inner_products(df, df.limit(0)).count() == 0
    assert topk.top_inner_products(df.limit(0), df.limit(0)).count() == 0


def test_bounds_skip_most_annuli(spark, monkeypatch):
    """Clustered vectors: far fewer pairs are scored than there are."""
    random = np.random.default_rng(5)
    centres = random.normal(size=(20, 8)) * 10
    rows = [(i, [float(x) for x in centres[i % 20] + random.normal(size=8) * 0.1]) for i in range(2000)]
    monkeypatch.setattr(topk, "ANNULUS", 50)
    visited = []
    visit = topk._visit

    def counting(visits, *rest):
        visited.append(visits.count())
        return visit(visits, *rest)

    monkeypatch.setattr(topk, "_visit", counting)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = topk.top_inner_products(df, df.where("vec_id % 50 = 0"), pivots=40).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == by_hand(rows, range(0, 2000, 50), 5)
    assert sum(visited) < 40 * 40 * 0.7  # of 40 queries and at least 40 annuli
