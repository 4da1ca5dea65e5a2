import datetime

import pytest

from pyspark.sql import functions as F

from proofmark.operators.report import answer_text, chart_of
from proofmark.plans.answer import answer_question, execute_plan, plan_question, reproducible
from proofmark.plans import questions as resolver
from proofmark.plans.questions import question_catalog
from proofmark.workspace import settle

ROWS = [
    (1, datetime.date(2025, 3, 1), "Bandung", "Electronics", 100, 1),
    (2, datetime.date(2025, 3, 2), "Bandung", "Home", 200, 2),
    (3, datetime.date(2025, 4, 1), "Jakarta", "Electronics", 60, 1),
    (4, datetime.date(2025, 4, 2), "Jakarta", "Home", 180, None),
]
SCHEMA = "order_id int, order_date date, city string, category string, revenue int, quantity int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def catalog(table):
    return settle(question_catalog("dataset", table), "catalog")


@pytest.mark.parametrize(
    ("question", "intent", "required"),
    [
        ("Berapa total revenue?", "total", ["revenue"]),
        ("Berapa rata-rata quantity?", "average", ["quantity"]),
        ("Berapa jumlah baris untuk Bandung?", "count", ["city"]),
        ("Kategori mana paling tinggi berdasarkan revenue?", "top", ["revenue", "category"]),
        ("Tampilkan revenue per kota.", "grouped", ["revenue", "city"]),
        ("Mengapa revenue turun pada April?", "comparison", ["order_date", "revenue", "category"]),
        ("Bagaimana revenue dibandingkan pada April per kota?", "comparison", ["order_date", "revenue", "city"]),
        ("Kolom mana yang kosong?", "quality", list("x")),
        ("Is the discount strata for revenue stopped?", "total", ["revenue"]),
        ("DROP TABLE dataset; lalu berapa total revenue?", "total", ["revenue"]),
    ],
)
def test_intents(table, catalog, question, intent, required):
    plan = plan_question(table, question, catalog)
    assert plan.intent == intent
    assert plan.required_columns == (table.columns if intent == "quality" else required)


def test_comparison_answer(table, catalog):
    answer = answer_question(table, "Mengapa revenue turun pada April per kategori?", catalog=catalog)
    assert answer.status == "completed" and answer.validation["status"] == "passed"
    months, segments = answer.evidence
    assert [r["metric_value"] for r in months["rows"]] == [300, 240]
    assert segments["rows"][0] == {
        "segment": "Electronics", "previous_value": 100, "current_value": 60, "delta": -40,
    }
    assert "dari **300** menjadi **240** (**-20.0%**)" in answer.text
    assert answer.chart["x"] == "month" or answer.chart["x"] == "segment"
    assert reproducible(table, answer.evidence)


@pytest.mark.parametrize(
    "question",
    [
        "Berapa total revenue Bandung?",
        "Berapa rata-rata revenue?",
        "Berapa jumlah data Jakarta?",
        "Kota teratas berdasarkan revenue?",
        "Tampilkan quantity per kategori.",
        "Audit data kosong.",
        "Mengapa revenue turun pada April per kota?",
    ],
)
def test_frame_and_sql_agree(table, catalog, question):
    answer = answer_question(table, question, catalog=catalog)
    assert answer.status == "completed"
    assert reproducible(table, answer.evidence)
    assert all(f"evidence:{e['key']}" in answer.text for e in answer.evidence)


def test_approval_stops_before_any_evidence(table, catalog):
    waiting = answer_question(table, "Berapa total revenue?", "approval", catalog)
    assert waiting.status == "awaiting_approval" and waiting.evidence == []
    done = execute_plan(table, waiting.plan)
    assert done.evidence[0]["rows"] == [{"metric_value": 540, "non_null_count": 4}]


def test_refusals(spark, table, catalog):
    with pytest.raises(ValueError, match="tidak boleh kosong"):
        answer_question(table, "   ", catalog=catalog)
    with pytest.raises(ValueError, match="kolom numerik"):
        answer_question(spark.createDataFrame([("a",)], "name string"), "Berapa total?")
    with pytest.raises(ValueError, match="Mode"):
        answer_question(table, "Berapa total?", "now", catalog)


def test_value_with_quote_and_regex_characters(spark):
    df = spark.createDataFrame([("O'Neil (x)", 5), ("b\\c d", 7), ("plain", 1)], "team string, amount int")
    for value, total in (("O'Neil (x)", 6), ("b\\c d", 7)):
        answer = answer_question(df, f"Total amount untuk {value}")
        expected = 13 if "(" in value else total
        assert answer.evidence[0]["rows"][0]["metric_value"] == expected
        assert reproducible(df, answer.evidence)


def test_texts(spark):
    grouped = {"id": "e", "key": "top_segments", "rows": [{"segment": c, "metric_value": i} for i, c in enumerate("abcd")]}
    text = answer_text(spark, "Q", "aggregate", [grouped])
    assert "- `c`: **2**" in text and "- `d`" not in text and "**4**" in text
    quality = {"key": "missing_values", "rows": [{"column": "n", "missing_count": 3, "missing_rate": 0.6}]}
    assert "- `n`: **60.0%**" in answer_text(spark, "Q", "quality", [quality])
    assert "tidak menghasilkan baris" in answer_text(spark, "Q", "comparison", [])
    assert chart_of(spark, [quality]) is None
    assert chart_of(spark, [grouped])["points"][0] == {"x": "a", "y": 0}


def test_any_value_can_filter(spark):
    df = spark.createDataFrame([(f"town{i}", i) for i in range(1, 9)] * 3, "city string, revenue int")
    answer = answer_question(df, "Berapa total revenue untuk town7?")
    assert answer.evidence[0]["rows"][0]["metric_value"] == 21
    assert answer.plan.steps[0] == "filter data" and answer.plan.visualization["type"] == "kpi"


def test_failing_query_is_a_result(spark, tmp_path):
    df = spark.createDataFrame([("x", 5)], "city string, revenue int").selectExpr(
        "city", "CAST(raise_error('broken') AS INT) AS revenue"
    )
    plan = plan_question(df, "Berapa total revenue?", values=spark.createDataFrame([], VALUES))
    path = str(tmp_path / "trace")
    failed = execute_plan(df, plan, trace=path)
    assert failed.status == "failed" and failed.text is None
    assert failed.validation["issues"][-1]["type"] == "execution_error"
    assert not failed.validation["checks"]["executed_without_error"]
    kept = {r["kind"]: r["status"] for r in spark.read.parquet(path).collect()}
    assert kept == {"query": "failed", "validation": "revision_required"}


def test_trace_of_an_answer(table, catalog, tmp_path):
    path = str(tmp_path / "trace")
    answer = answer_question(table, "Tampilkan revenue per kota.", catalog=catalog, trace=path)
    rows = table.sparkSession.read.parquet(path).orderBy("sequence").collect()
    assert [r["kind"] for r in rows] == ["query", "validation", "artifact", "evaluation"]
    assert rows[-1]["detail"] == "1.0" and rows[0]["detail"] == answer.evidence[0]["sql"]


VALUES = (
    "dataset_id string, position int, column string, value string, pattern string, words string, width int"
)


def test_values_no_question_can_name_are_dropped(spark):
    """Whole documents and values of other words go; every named value stays, in any spelling."""
    values = ["Bandung Kota", "kota tua", "word " * 5_000, "Zürich", "n/a-x", "absent", "Bandung"]
    df = spark.createDataFrame([(v,) for v in values * 3], "city string")
    questions = spark.createDataFrame(
        [("d", "Total di bandung kota?"), ("d", "Total ZÜRICH dan N/A-X."), ("d", None), ("e", "absent")],
        "dataset_id string, text string",
    )
    index = resolver.value_index("d", df)
    asked = questions.withColumns({"_lowered": F.lower("text")}).withColumn(
        "_words", resolver._words(F.col("_lowered"))
    )
    left = {r["value"] for r in resolver.nameable(index, asked).collect()}
    assert left == {"Bandung Kota", "Zürich", "n/a-x", "Bandung"}
    found = {
        r["text"]: [(f["column"], f["value"]) for f in r["filters"]]
        for r in resolver.value_filters(questions, index).collect()
    }
    assert found == {
        "Total di bandung kota?": [("city", "Bandung Kota")],
        "Total ZÜRICH dan N/A-X.": [("city", "Zürich")],
    }


def test_no_questions_and_no_values(spark):
    none = spark.createDataFrame([], "dataset_id string, text string")
    index = resolver.value_index("d", spark.createDataFrame([("abc",)], "city string"))
    assert resolver.value_filters(none, index).collect() == []
    assert resolver.with_filters(none, index).collect() == []
