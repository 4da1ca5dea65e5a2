import datetime
from decimal import Decimal

import pytest

from proofmark import profile
from proofmark.operators import aggregates as a
from proofmark.operators import profile as p

ROWS = [
    (1, "x@example.com", None, 10.0, datetime.date(2025, 1, 3), {"k": 1}, b"\x01"),
    (2, "y@example.com", "note", None, datetime.date(2025, 2, 3), {"k": 1}, b"\x01"),
    (3, "x@example.com", None, 30.0, None, {"k": 2}, None),
    (3, "x@example.com", None, 30.0, None, {"k": 2}, None),
]
SCHEMA = (
    "order_id int, email string, notes string, revenue double, day date, "
    "tags map<string,int>, raw binary"
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def found(table):
    return profile(table)


def test_columns(found):
    rows = {r["column"]: r for r in found.columns.collect()}
    assert rows["notes"]["missing_count"] == 3 and rows["notes"]["missing_rate"] == 0.75
    assert [rows[c]["distinct_count"] for c in ("order_id", "email", "tags", "raw")] == [3, 2, 2, 1]
    assert rows["email"]["sample_values"] == ["x@example.com", "y@example.com"]
    assert (rows["revenue"]["min"], rows["revenue"]["median"], rows["revenue"]["max"]) == (10.0, 30.0, 30.0)
    assert (rows["day"]["start"], rows["day"]["end"]) == ("2025-01-03", "2025-02-03")
    assert rows["order_id"]["is_identifier"] and rows["email"]["is_pii"] and rows["revenue"]["is_target"]


def test_table_row(found):
    row = found.table.first()
    assert (row["row_count"], row["duplicate_count"], row["duplicate_rate"]) == (4, 1, 0.25)
    assert row["warnings"] == [
        "Ditemukan 1 baris duplikat.",
        "Kolom dengan missing >=20%: notes, revenue, day, raw",
        "Potensi PII: email",
    ]


def test_missing_equals_brute_force(table):
    for row in p.missing(table).collect():
        i = table.columns.index(row["column"])
        assert row["missing_count"] == sum(r[i] is None for r in ROWS)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, email string, day date")
    found = profile(empty)
    assert {r["missing_rate"] for r in found.columns.collect()} == {0.0}
    row = found.table.first()
    assert row["row_count"] == 0 and row["duplicate_rate"] == 0.0
    assert row["warnings"] == ["Dataset tidak memiliki baris.", "Potensi PII: email"]
    assert {r["missing_rate"] for r in a.missing_values(empty).collect()} == {None}


def test_long_texts_are_counted_and_sampled_whole(spark):
    long_a, long_b = "a" * 500, "a" * 499 + "b"
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,), ("short",)], "text string")
    assert p.distinct(df).first()["distinct_count"] == 3
    assert {r["value"]: r["n"] for r in p.samples(df).collect()} == {long_a: 2, long_b: 1, "short": 1}


def test_sample_ties_are_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "gfedcbaa"], "v string")
    rows = sorted(p.samples(df).collect(), key=lambda r: r["position"])
    assert [r["value"] for r in rows] == ["a", "b", "c", "d", "e"]


def test_odd_names_and_types(spark):
    df = spark.createDataFrame(
        [(1.5, Decimal("2.50"), [1, 2], -0.0), (1.5, None, [1, 2], 0.0)],
        "`a.b` double, `c``d` decimal(10,2), arr array<int>, zero double",
    )
    rows = {r["column"]: r for r in profile(df).columns.collect()}
    assert rows["a.b"]["median"] == 1.5 and rows["c`d"]["max"] == 2.5
    assert rows["arr"]["distinct_count"] == 1 and rows["zero"]["distinct_count"] == 1


def test_approximate_distinct_is_close(spark):
    df = spark.range(20000).selectExpr("id", "id % 100 AS small", "CAST(NULL AS string) AS none")
    found = {r["column"]: r["distinct_count"] for r in p.distinct_approx(df).collect()}
    assert abs(found["id"] - 20000) < 1000 and abs(found["small"] - 100) < 3 and found["none"] == 0


# --- aggregates -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (datetime.date(2024, 12, 5), "A", 100),
        (datetime.date(2024, 12, 9), "B", 50),
        (datetime.date(2025, 1, 2), "A", 70),
        (datetime.date(2025, 1, 8), None, 5),
        (datetime.date(2023, 12, 8), "A", 999),
    ]
    return spark.createDataFrame(rows, "day date, seg string, amount int")


def test_january_is_compared_with_december_of_the_year_before(sales):
    rows = a.monthly_comparison(sales, "day", "amount", 1, 2025).collect()
    assert [(r["month"], int(r["metric_value"])) for r in rows] == [(12, 150), (1, 75)]
    change = a.change_rate(a.monthly_comparison(sales, "day", "amount", 1, 2025), 1).first()
    assert (change["change"], change["rate"]) == (-75.0, -0.5)


def test_unknown_year_takes_all_years(sales):
    rows = a.monthly_comparison(sales, "day", "amount", 1).collect()
    assert [int(r["metric_value"]) for r in rows] == [1149, 75]


def test_segment_contribution_keeps_the_null_segment(sales):
    rows = a.segment_contribution(sales, "day", "amount", "seg", 1, 2025).collect()
    assert [(r["segment"], int(r["delta"])) for r in rows] == [("B", -50), ("A", -30), (None, 5)]


def test_text_dates_are_cast(sales):
    text = sales.selectExpr("CAST(day AS string) AS day", "seg", "amount")
    rows = a.monthly_comparison(text, "day", "amount", 1, 2025).collect()
    assert [int(r["metric_value"]) for r in rows] == [150, 75]


def test_change_rate_without_base(spark):
    monthly = spark.createDataFrame([(3, 0.0), (4, 7.0)], "month int, metric_value double")
    row = a.change_rate(monthly, 4).first()
    assert row["change"] == 7.0 and row["rate"] is None
    assert a.change_rate(monthly.where("month = 4"), 4).first()["change"] is None


def test_integer_sums_do_not_overflow(spark):
    df = spark.createDataFrame([(2**62,)] * 4, "amount long")
    assert int(a.total_metric(df, "amount").first()["metric_value"]) == 2**64


# --- plans ------------------------------------------------------------------------------------


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_month_filter_reaches_the_scan(sales, tmp_path):
    sales.write.parquet(str(tmp_path / "sales"))
    stored = sales.sparkSession.read.parquet(str(tmp_path / "sales"))
    plan = plan_of(a.segment_contribution(stored, "day", "amount", "seg", 1, 2025))
    assert "GreaterThanOrEqual(day" in plan and "LessThan(day" in plan
    assert "TakeOrderedAndProject" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_missing_values_scan_once(sales, tmp_path):
    sales.write.parquet(str(tmp_path / "sales"))
    stored = sales.sparkSession.read.parquet(str(tmp_path / "sales"))
    assert plan_of(p.missing(stored)).count("FileScan") == 1


def test_samples_of_long_and_nested_values(spark):
    long = "b" * 63 + "yz" * 50
    rows = [([1.5] * 40, {"k": 1}, "a" * 70, bytearray(range(60))), ([2.0], {"j": 2}, long, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "v array<double>, m map<string,int>, t string, b binary")
    found = {}
    for r in p.samples(df).orderBy("column", "position").collect():
        found.setdefault(r["column"], []).append(r["value"])
    assert found["t"] == ["a" * 70, long]
    assert found["b"] == [bytes(range(60)).hex().upper(), "78"]
    assert found["v"] == ["[" + ",".join(["1.5"] * 40) + "]", "[2.0]"]
    assert found["m"] == ['[{"key":"j","value":2}]', '[{"key":"k","value":1}]']
