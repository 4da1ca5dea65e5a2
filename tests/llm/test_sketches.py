import hashlib

import pytest
from pyspark.sql import functions as F

from proofmark.llm import sketch as s

TEXTS = [
    (5, "alpha beta gamma delta " * 3), (1, None), (2, ""), (9, "ü🙂" * 9), (7, "alpha beta gamma delta " * 3),
    (12, " ".join(f"w{i}" for i in range(900))), (20, "one"), (21, "abc"), (30, " ".join(f"x{i}" for i in range(40))),
]


def edits(rows):
    ordered = sorted(rows, key=lambda r: r[0])
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        quarter = len(text) // 4
        yield i, text, text[: len(text) - quarter] + after[:quarter], after


@pytest.mark.parametrize("partitions", [1, 5])
def test_edits_equal_python(spark, partitions):
    df = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, edited string")
    rows = {r["doc_id"]: r for r in s.fingerprint_edits(df.repartition(partitions)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text, edited, after in edits(TEXTS):
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["edited_fingerprint"] == r["fingerprint"] and r["near_edited"] == 1
        if after == text:
            assert r["near_next"] == 1
    assert rows[5]["fingerprint"] == rows[7]["fingerprint"] != rows[12]["fingerprint"]
    assert rows[12]["near_edited"] > 0.6 and rows[12]["near_next"] == 0


def test_single_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "abcd efgh"), (None, "abcd efgh"), (3, "ijkl")], "doc_id long, text string")
    rows = s.fingerprint_edits(df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "None", "None"]
    one = s.fingerprint_edits(df.where("doc_id = 3")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"ijki").hexdigest() and one["near_next"] == 1
    assert s.fingerprint_edits(df.limit(0)).count() == 0


def test_containment_of_unequal_texts_and_merging(spark):
    words = [f"t{i}" for i in range(4000)]
    texts = [("whole", " ".join(words)), ("part", " ".join(words[1000:1400])), ("a", " ".join(words[:2000])), ("b", " ".join(words[2000:]))]
    df = s.with_sketch(spark.createDataFrame(texts, "name string, text string"), "text", "k")
    wide = df.groupBy().pivot("name", [n for n, _ in texts]).agg(F.first("k"))
    merged = wide.withColumn("joined", s.merged(F.col("a"), F.col("b")))
    row = merged.select(
        s.likeness("part", "whole").alias("part"),
        s.likeness("joined", "whole").alias("joined"),
        s.likeness("a", "b").alias("halves"),
        F.size("whole.hashes").alias("kept"),
    ).first()
    assert row["part"] == 1 and row["joined"] >= 0.98 and row["halves"] == 0
    assert 150 < row["kept"] < 350  # 1/16 of about 4000


def test_plan_has_no_python_and_one_shuffle_of_texts(spark):
    df = s.fingerprint_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
