"""Operator 12 against DuckDB, which builds the trees by recursion, and by hand."""

from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.llm import manifest as m
from tests import oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def compare(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, SCHEMA)
    connection = duckdb.connect()
    connection.register("documents", frame.toArrow())
    for name in extra:
        frame = frame.withColumn(name, F.lit("x"))
    assert oracle.compare(m.document_proofs(frame), connection, m.OP12_SQL) == ""


def test_trees_of_every_depth(spark):
    rows = [(i, f"Text {i}", "deep", "s", i) for i in range(4400)]
    rows += [(i, f"TEXT {i}", "whole", "s", None) for i in range(4096)]
    rows += [(i, "a", f"l{i % 70:02}", None, 1) for i in range(1000)]
    rows += [(7, "alone", "single", "s", 5)]
    compare(spark, rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = [
        (None, "No id", "en", "s", 5),
        (1, None, "en", "s", None),
        (1, "", "en", None, 0),
        (3, "Same Text", None, "s", 9),
        (3, "Same Text", None, "s", 9),
        (4, "ÄÖ Äpfel İ", "", "s", 10),
        (5, "Long " * 200_000, "é", "s", 1_000_000),
    ]
    compare(spark, rows, extra=("tree", "at", "digest", "block", "level", "n", "before"))


def test_empty_table(spark):
    assert m.document_proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_is_its_own_root(spark):
    row = m.document_proofs(spark.createDataFrame([(8, "low", "en", "s", 3)], SCHEMA)).first()
    leaf = sha256(b"1:81:s2:en1:33:low").hexdigest()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf
    assert row["proof_sha256"] == sha256(b"").hexdigest() and row["verified"]


def test_missing_nodes_are_the_least_set():
    # Both halves of one run: nothing of it is missing, only what is beside it further up.
    assert m.missing_nodes(np.arange(8), 64) == [(1, i) for i in range(1, 8)]
    assert m.missing_nodes(np.array([3]), 1) == []
    assert m.missing_nodes(np.array([0, 9]), 10) == [(0, i) for i in range(1, 9) if i != 8] + [(0, 8)]
    # The last run is short.
    assert m.missing_nodes(np.array([8]), 10) == [(0, 9), (1, 0)]


@pytest.mark.parametrize("keep", [1, 7, 300])
def test_proofs_of_some_rows(spark, keep):
    rows = spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "a").alias("lang"),
        F.sha2(F.col("id").cast("string"), 256).alias("digest"),
        F.lit(None).cast("string").alias("changed"),
    )
    manifest = m.build(rows, ["changed"])
    some = manifest.leaves.where(F.col("doc_id") % keep == 0)
    found = m.prove(manifest, some)
    assert found.count() == some.count()
    assert found.where((F.col("folded_root") == F.lit(manifest.root)) & (F.col("root") == F.lit(manifest.root))).count() == some.count()
    changed = m.prove(manifest, some.withColumn("changed", F.sha2(F.lit("other"), 256)))
    assert changed.where(F.col("folded_root") == F.lit(manifest.root)).count() == 0
