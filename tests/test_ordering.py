"""Distributed positions, ranks and medians against brute force, with one hot group."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from proofmark.operators import ordering as o


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Keep adaptive execution from merging the small test slices into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group, a third of the values equal; NULL keys and values."""
    return spark.createDataFrame(_rows(), "id long, grp string, value double")


def _rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(20000):
        group = "hot" if i % 2 == 0 else None if i % 97 == 0 else f"g{i % 50}"
        value = 5.0 if i % 3 == 0 else None if i % 101 == 0 else round(float(rng.random()) * 1000, 1)
        rows.append((i, group, value))
    return rows


def test_place_in_order_equals_row_number(skewed):
    placed = o.place_in_order(skewed, ["grp"], ["value", "id"])
    window = Window.partitionBy("grp").orderBy("value", "id")
    checked = placed.withColumn("wanted", F.row_number().over(window) - 1)
    assert checked.where(F.col("before") != F.col("wanted")).count() == 0
    assert checked.count() == 20000


def test_hot_group_is_spread_over_slices(skewed):
    slices = o.in_slices(skewed, ["grp", "value", "id"]).where("grp = 'hot'").groupBy("_slice").count()
    sizes = [r["count"] for r in slices.collect()]
    assert sum(sizes) == 10000 and len(sizes) >= 3 and max(sizes) < 5000


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_average_rank(skewed, by):
    found = {tuple(r[k] for k in [*by, "value"]): r["avg_rank"] for r in o.average_rank(skewed, "value", by).collect()}
    groups = {}
    for _, group, value in _rows():
        if value is not None:
            groups.setdefault(group if by else None, []).append(value)
    for group, values in groups.items():
        v = np.array(values)
        for q in np.unique(v)[::37]:
            key = (group, q) if by else (q,)
            assert found[key] == (v < q).sum() + ((v == q).sum() + 1) / 2


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_exact_medians(skewed, monkeypatch, limit):
    """Both finishing paths: one sort per group, and placed slices."""
    monkeypatch.setattr(o, "_ONE_SORT", limit)
    groups = {}
    for _, group, value in _rows():
        if value is not None:
            groups.setdefault(group, []).append(value)
    found = {r["grp"]: r for r in o.exact_medians(skewed, ["value"], ["grp"]).collect()}
    for group, values in groups.items():
        assert found[group]["median"] == np.median(values)
        assert found[group]["n"] == len(values)
    everything = [v for values in groups.values() for v in values]
    assert o.exact_medians(skewed, ["value"]).first()["median"] == np.median(everything)


def test_median_of_nothing(spark):
    empty = spark.createDataFrame([], "value double")
    assert o.exact_medians(empty, ["value"]).collect() == [] or (
        o.exact_medians(empty, ["value"]).first()["median"] is None
    )
    nulls = spark.createDataFrame([(None,)], "value double")
    assert o.exact_medians(nulls, ["value"]).first()["median"] is None


def test_not_a_number_sorts_last(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("nan"),)], "value double")
    assert o.exact_medians(df, ["value"]).first()["median"] == 3.0


def test_many_groups_use_a_written_table(spark):
    df = spark.range(6000).selectExpr("id % 2000 AS k", "CAST(id AS DOUBLE) AS v")
    found = o.exact_medians(df, ["v"], ["k"])
    assert found.where("median <> k + 2000").count() == 0 and found.count() == 2000


def test_scratch_folder_and_columnar_inputs(spark):
    from pathlib import Path

    from proofmark.workspace import _run_folder, columnar, pin

    kept = pin(spark.range(5), "five")
    assert kept.count() == 5 and list(Path(_run_folder(spark)).glob("five-*"))
    assert columnar(kept.where("id > 1")) is not None and columnar(kept).sameSemantics(kept)
    joined = kept.join(spark.range(3), "id")
    assert not columnar(joined).sameSemantics(joined) and columnar(joined).count() == 3
