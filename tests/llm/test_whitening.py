"""Operator 13 against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    width = max(map(len, vectors))
    full = [[*v, *[0.0] * (width - len(v))] for v in vectors]
    x = np.floor(64 * np.array(full)) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    deviation = ((n * x - sums) ** 2).sum(axis=1).astype(np.int64)
    order = np.argsort(-values)
    order = order[values[order] > 1e-9 * values.sum()][:32]
    return centred @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation


def check(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in extra:
        frame = frame.withColumn(name, F.lit(1))
    found = w.whiten(frame).toPandas()
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    white, share, deviation = brute([np.array(v, np.float32).astype(float) for _, v in kept])
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in kept]].to_numpy()
    assert got.shape == white.shape
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-7
    first = found.drop_duplicates("vec_id").set_index("vec_id")
    assert first.loc[[i for i, _ in kept], "deviation"].tolist() == deviation.tolist()
    assert np.allclose(found.sort_values("component")["explained"].unique(), share, rtol=1e-6)
    assert (found["n"] == len(kept)).all() and found["identity_error"].nunique() == 1
    assert found["identity_error"].iloc[0] < 1e-9


def test_equals_dense(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, (rng.normal(size=40) * rng.random(40)).tolist()) for i in range(700)])


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6)]
    rows += [(104, [3.0]), (105, []), (106, rows[0][1]), (107, rows[0][1]), (108, [4000.0] * 6)]
    check(spark, rows, extra=("x", "n", "part", "deviation", "component"))


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [a, 2 * a, 7.0, b, 7.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (90, 2)).astype(float).tolist())]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    found = w.whiten(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == [c.split()[0] for c in w._RESULT.split(", ")] and found.count() == 0


def test_null_and_repeated_ids_are_rows(spark):
    rows = [(None, [1.0, 2.0]), (1, [2.0, 5.0]), (1, [4.0, 1.0]), (1, [4.0, 1.0])]
    found = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 8 and sum(r["vec_id"] is None for r in found) == 2


@pytest.mark.parametrize("kind", ["plain", "equal columns", "repeated", "whole", "tiny and huge"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)) + 50
    if kind == "equal columns":
        x[:, 8:16] = x[:, :8]
    if kind == "repeated":
        x = np.repeat(x[:5], 180, axis=0)
    if kind == "whole":
        x = np.round(x)
    if kind == "tiny and huge":
        x *= np.logspace(-7, 7, 24)
    parts = []
    for rows in np.array_split(x, 4):
        parts.append(w.Spectrum(24))
        for row in rows[:20]:
            parts[-1].add(row[None, :])
        parts[-1].add(rows[20:])
    whole = w.Spectrum(24)
    for p in parts:
        whole.merge(p.n, p.mean, p.values, p.vectors)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    size = np.linalg.eigvalsh(scatter)[-1]
    again = whole.vectors @ np.diag(whole.values) @ whole.vectors.T
    assert whole.n == 900 and np.abs(again - scatter).max() < 1e-11 * size
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(24)).max() < 1e-11
    assert np.abs(whole.values - np.linalg.eigvalsh(scatter)).max() < 1e-11 * size
