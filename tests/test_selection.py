"""Exact minima, maxima and medians against Python's own numbers."""

import math
import random
from decimal import Decimal

import pytest

from proofmark import exact_numbers
from proofmark.operators import selection


def found_in(df):
    return {r["column"]: r.asDict() for r in exact_numbers(df).collect()}


def brute(values):
    ordered = sorted(values)
    return ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]


@pytest.mark.parametrize("size", [1, 2, 999, 1000])
@pytest.mark.parametrize("few", [1, selection.FEW])
def test_every_digit_is_kept(spark, monkeypatch, size, few):
    """Both ends of the levels: down to one value, and the last values counted at once."""
    monkeypatch.setattr(selection, "FEW", few)
    random.seed(size)
    longs = [random.choice([-(2**63), 2**63 - 1, 2**53 + 1, random.getrandbits(63)]) for _ in range(size)]
    wide = [Decimal(random.randint(-(10**38) + 1, 10**38 - 1)) for _ in range(size)]
    cents = [Decimal(random.randint(-(10**20), 10**20)).scaleb(-10) for _ in range(size)]
    reals = [random.choice([1e-300, -1e300, 0.1, random.gauss(0, 1)]) for _ in range(size)]
    df = spark.createDataFrame(
        list(zip(longs, wide, cents, reals)), "l long, w decimal(38,0), c decimal(38,10), r double"
    )
    rows = found_in(df)
    for name, values, read in (("l", longs, int), ("w", wide, Decimal), ("c", cents, Decimal), ("r", reals, float)):
        row = rows[name]
        assert row["n"] == size
        assert (read(row["min"]), read(row["max"])) == (min(values), max(values))
        assert (read(row["lower_median"]), read(row["upper_median"])) == brute(values)
    low, high = brute(longs)
    assert Decimal(rows["l"]["median"]) * 2 == low + high


def test_neighbours_beyond_the_doubles(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 1,), (2**53 + 2,)], "v long")
    row = found_in(df)["v"]
    assert row["median"] == row["lower_median"] == str(2**53 + 1)
    assert row["max"] == str(2**53 + 2)


def test_a_value_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 10)
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, id, 9007199254740993) AS v", "CAST(id % 7 AS tinyint) AS t")
    rows = found_in(df)
    assert rows["v"]["median"] == "9007199254740993" and rows["t"]["median"] == "3"


def test_odd_values(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(nan, -0.0, None, 1.5), (nan, 0.0, None, None), (1.0, 0.0, None, 2.5)],
        "a double, `b.c` double, none decimal(20,3), f float",
    )
    rows = found_in(df)
    assert math.isnan(float(rows["a"]["median"])) and rows["a"]["min"] == "1.0"
    assert rows["b.c"]["min"] == rows["b.c"]["max"] == rows["b.c"]["median"] == "0.0"
    assert rows["none"] == {"column": "none", "n": 0} | dict.fromkeys(
        ("min", "max", "lower_median", "upper_median", "median")
    )
    assert rows["f"]["median"] == "2.0"


def test_without_rows_or_numbers(spark):
    assert found_in(spark.createDataFrame([], "v long, s string"))["v"]["n"] == 0
    assert exact_numbers(spark.createDataFrame([("x",)], "s string")).count() == 0
