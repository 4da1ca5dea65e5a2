import datetime

import pytest
from pyspark.sql import functions as F

from proofmark.operators import evaluate as e
from proofmark.operators import report, trace
from proofmark.operators.user_code import grouped_apply
from proofmark.sources import ingest, readers, sinks

CSV = "id,day,name,score\n1,2025-01-03,Ann,1.5\n2,2025-01-04,,2\n3,,Bob,\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    (path / "a.csv").write_text(CSV)
    (path / "copy.csv").write_text(CSV)
    (path / "empty.csv").write_text("")
    (path / "notes.txt").write_text("x")
    (path / "b.PARQUET").write_bytes(b"x" * 2048)
    return path


def test_scan_csv_types_and_nulls(spark, folder):
    df = readers.scan_csv(spark, str(folder / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "date", "string", "double"]
    assert df.where("name IS NULL").count() == 1


def test_read_table_rejects_other_formats(spark, folder):
    assert readers.read_table(spark, str(folder / "a.csv")).count() == 3
    with pytest.raises(ValueError, match="Format"):
        readers.read_table(spark, str(folder / "notes.txt"))


def test_infer_and_coerce(spark):
    rows = [("1", "2025-01-03", "1e3", "x", "", "12d"), ("-2", "2025-01-04T10:00", "", "y", None, "1")]
    df = spark.createDataFrame(rows, "i string, d string, f string, s string, none string, suffix string")
    types = {r["column"]: r["type"] for r in readers.infer_types(df).collect()}
    assert types == {"i": "BIGINT", "d": "DATE", "f": "DOUBLE", "s": "VARCHAR", "none": "VARCHAR", "suffix": "VARCHAR"}
    first, second = readers.coerce_types(df, types).collect()
    assert (first["i"], first["f"], second["f"]) == (1, 1000.0, None)
    assert second["d"] == datetime.datetime(2025, 1, 4, 10, 0)


def test_admission(spark, folder):
    found = {r["name"]: r["reason"] for r in ingest.admit_files(ingest.list_files(spark, str(folder))).collect()}
    assert found == {
        "a.csv": None,
        "copy.csv": None,
        "notes.txt": "Format harus CSV atau Parquet.",
        "b.PARQUET": None,
    }
    manifest = spark.createDataFrame([("/x/empty.csv", 0), ("/x/ .. ", 3)], "path string, length long")
    reasons = [r["reason"] for r in ingest.admit_files(manifest).collect()]
    assert reasons == ["File kosong.", "Nama file tidak valid."]
    limited = ingest.admit_files(ingest.list_files(spark, str(folder)), max_mb=0)
    assert limited.where("name = 'a.csv'").first()["reason"] == "Ukuran file melebihi 0 MB."


def test_fingerprints_and_dedupe(spark, folder):
    prints = ingest.fingerprint_files(spark, str(folder))
    by_name = {r["name"]: r["fingerprint"] for r in prints.collect()}
    assert by_name["a.csv"] == by_name["copy.csv"] and by_name["a.csv"].startswith("sha256:")
    known = spark.createDataFrame([("ds_1", by_name["b.PARQUET"])], "id string, fingerprint string")
    rows = {r["fingerprint"]: r for r in ingest.dedupe_ingest(prints, known).collect()}
    assert rows[by_name["a.csv"]]["file_count"] == 2 and rows[by_name["a.csv"]]["name"] == "a.csv"
    assert rows[by_name["b.PARQUET"]]["existing_id"] == "ds_1" and not rows[by_name["b.PARQUET"]]["is_new"]


def test_table_fingerprint_ignores_order_and_layout(spark):
    df = spark.range(500).selectExpr("id", "map('a', id, 'b', 1L) AS m", "CAST(id AS string) AS s")
    same = df.orderBy(F.desc("id")).repartition(7)
    prints = [ingest.fingerprint_table(x).first()["fingerprint"] for x in (df, same, df.where("id > 0"))]
    assert prints[0] == prints[1] != prints[2]


def test_bounded_result_flag(spark):
    assert sinks.bounded_result(spark.range(3), cap=3).first()["truncated"]
    assert not sinks.bounded_result(spark.range(2), cap=3).first()["truncated"]


def test_evidence_rows_keep_order_and_json_types(spark):
    df = spark.createDataFrame(
        [(2, datetime.date(2025, 1, 3), b"\x0f"), (1, None, None)], "n int, day date, raw binary"
    )
    row = sinks.evidence_envelope(df, "k", "p", "SELECT 1", [F.asc("n")]).first()
    assert row["rows"] == ['{"n":1,"day":null,"raw":null}', '{"n":2,"day":"2025-01-03","raw":"0f"}']
    assert row["row_count"] == 2 and not row["truncated"]


# --- evaluation -------------------------------------------------------------------------------


def test_numerical_score_edges(spark):
    cases = [
        (1.0, 1.0000001, 1.0), (1.0, 1.1, 0.0), (None, 1.0, 0.0), (float("nan"), 1.0, 0.0),
        (float("nan"), float("nan"), 0.0), (float("inf"), float("inf"), 1.0), (float("inf"), 1.0, 0.0),
        (0.0, 1e-7, 1.0), (1e12, 1e12 + 1e5, 1.0),
    ]
    df = spark.createDataFrame(cases, "a double, e double, wanted double")
    scored = df.withColumn("got", e.numerical_score(F.col("a"), F.col("e"), F.lit(1e-6)))
    assert [r["got"] for r in scored.collect()] == [c[2] for c in cases]


def test_rows_equal_counts_multiplicity(spark):
    left = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    right = spark.createDataFrame([(1,), (None,), (None,)], "x int")
    row = e.rows_equal(left, right).first()
    assert (row["only_left"], row["only_right"], row["equal"]) == (1, 1, False)
    assert e.rows_equal(left, left).first()["equal"]
    assert e.rows_equal(left.limit(0), left.limit(0)).first()["equal"]


def test_summary_of_nothing(spark):
    schema = (
        "status string, score double, numeric_case boolean, execution_success boolean, evidence_coverage double, "
        "read_only_sql_valid boolean, reproducible boolean, latency_ms int, category string"
    )
    row = e.benchmark_summary(spark.createDataFrame([("passed", 1.0, None, True, None, None, None, 4, "c")], schema)).first()
    assert (row["total"], row["numeric_rate"], row["policy_rate"], row["median_latency_ms"]) == (1, 0.0, 0.0, 4.0)


# --- trace ------------------------------------------------------------------------------------


def test_step_sequence_continues(spark):
    steps = spark.createDataFrame(
        [("a", 3, "x"), ("a", 1, "y"), ("b", 1, "z"), ("a", 1, "w")], "analysis_id string, created_at int, id string"
    )
    taken = spark.createDataFrame([("a", 10)], "analysis_id string, last_sequence int")
    found = {r["id"]: r["sequence"] for r in trace.step_sequence(steps, taken).collect()}
    assert found == {"w": 11, "y": 12, "x": 13, "z": 1}


def test_nested_trace(spark):
    analyses = spark.createDataFrame([(1, "completed"), (2, "failed")], "analysis_id int, status string")
    steps = spark.createDataFrame([(1, 2, "s2", "b"), (1, 1, "s1", "a")], "analysis_id int, sequence int, id string, payload string")
    other = spark.createDataFrame([(1, 5, "e1", "score")], "analysis_id int, created_at int, id string, payload string")
    full = trace.assemble_trace(analyses, steps, other.limit(0), other)
    assert full.count() == 4
    document = trace.nested_trace(full, [1]).first()
    assert [s["id"] for s in document["steps"]] == ["s1", "s2"]
    assert document["artifacts"] == [] and document["evaluations"][0]["payload"] == "score"


def test_redaction_reaches_every_depth(spark):
    df = spark.sql(
        "SELECT 1 AS id, '/p' AS storage_uri, "
        "named_struct('storage_uri', '/p', 'keep', array(named_struct('storage_uri', '/q', 'n', 2))) AS s, "
        "map('storage_uri', '/r', 'other', 'x') AS m"
    )
    row = trace.redact_fields(df).first().asDict(recursive=True)
    assert row == {"id": 1, "s": {"keep": [{"n": 2}]}, "m": {"other": "x"}}


def test_decode_json(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("broken",)], "props_json string")
    rows = trace.decode_json_columns(df, {"props_json": "k int"}).collect()
    assert rows[0]["props"]["k"] == 3 and (rows[1]["props"] is None or rows[1]["props"]["k"] is None)


def test_chart_takes_the_first_drawable_evidence(spark):
    rows = [
        (1, 0, "aggregate", 0, None, None, None, 5.0, None, None),
        *[(1, 1, "segment_contribution", i, f"s{i}", None, None, None, float(-i), None) for i in range(12)],
        *[(1, 2, "top_segments", i, f"t{i}", None, None, float(i), None, None) for i in range(3)],
    ]
    schema = (
        "analysis_id int, evidence_order int, evidence_key string, row_index int, segment string, `column` string, "
        "month string, metric_value double, delta double, missing_rate double"
    )
    points = report.chart_points(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert len(points) == 10 and points[3]["x"] == "s3" and points[3]["y"] == -3.0


def test_grouped_apply_merges_batches(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "CAST(id AS double) AS v").repartition(5)

    def partial(batch):
        return batch.groupby("k", as_index=False).agg(total=("v", "sum"))

    merged = grouped_apply(df, ["k"], partial, "k long, total double", [F.sum("total").alias("total")])
    assert {r["k"]: r["total"] for r in merged.collect()} == {0: 249500.0, 1: 250000.0}


def test_csv_follows_rfc_4180(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,said\n1,"He said ""hi"", ok"\n2,"two\nlines"\n3,\n')
    rows = readers.scan_csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'He said "hi", ok'), (2, "two\nlines"), (3, None)]


def test_every_file_has_a_row(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "large.csv").write_text("x" * 2_000_000)
    (tmp_path / "a" / "small.csv").write_text("x")
    rows = {r["name"]: r for r in ingest.fingerprint_files(spark, str(tmp_path), max_mb=1).collect()}
    assert rows["large.csv"]["fingerprint"] is None and "1 MB" in rows["large.csv"]["reason"]
    assert rows["small.csv"]["fingerprint"].startswith("sha256:")
