"""The most frequent values against a plain count of all values."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofmark.operators import frequent
from proofmark.operators import profile as p


def brute(rows, size):
    counts = Counter(str(v) for v in rows if v is not None)
    return sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:size]


def sampled(df, size=5):
    found = {}
    for r in sorted(p.samples(df, size=size).collect(), key=lambda r: r["position"]):
        found.setdefault(r["column"], []).append((r["value"], r["n"]))
    return found


@pytest.fixture(scope="module")
def mixed(spark):
    """Identifiers, falling frequencies, one hot value, ties, NULLs only."""
    return spark.range(30_000).select(
        "id",
        F.floor(F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000, F.lit(4)) * 9_000).alias("falling"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 9_000)).alias("hot"),
        (F.col("id") % 6_000).alias("tied"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("few"),
    )


def test_samples_equal_a_plain_count(mixed):
    rows = mixed.collect()
    found = sampled(mixed)
    for name in mixed.columns:
        assert found.get(name, []) == brute([r[name] for r in rows], 5), name


def test_what_the_summary_missed_is_found(mixed, monkeypatch):
    """The buckets, not the summary, decide: any candidates give the same result."""
    rows = mixed.collect()
    wrong = {"falling": ["8999", "nowhere"], "hot": ["v3"], "tied": ["17"], "few": ["2"]}
    monkeypatch.setattr(
        frequent, "candidates", lambda df, texts: {name: wrong.get(name, []) for name in texts}
    )
    found = sampled(mixed)
    for name in mixed.columns:
        assert found.get(name, []) == brute([r[name] for r in rows], 5), name


def test_only_open_buckets_are_counted(mixed):
    branch = frequent.frequent_values(mixed, {"falling": F.col("falling").cast("string")}, 5)["falling"]
    assert branch.count() < mixed.select("falling").distinct().count() / 10


def test_sketched_profile_takes_the_same_samples(mixed):
    exact, sketched = (
        {r["column"]: r["sample_values"] for r in p.profile(mixed, exact_distinct=flag).columns.collect()}
        for flag in (True, False)
    )
    assert exact == sketched


def test_empty_table_and_no_columns(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert p.samples(empty).collect() == []
    assert frequent.frequent_values(empty, {}, 5) == {}
