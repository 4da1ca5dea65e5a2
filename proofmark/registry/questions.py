"""Question understanding over one question per order.

The questions are derived from the orders table by one SQL expression that Spark and
DuckDB read alike, so their number grows with the data.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.operators.profile import date_ranges
from proofmark.plans import questions as q
from proofmark.plans.answer import answer_question as answer_one
from proofmark.plans.wording import (
    COMPARISON_PATTERN,
    COUNT_PATTERN,
    MEAN_PATTERN,
    MONTHS,
    QUALITY_PATTERN,
    TOP_PATTERN,
)
from proofmark.registry.base import query, table, union_sql
from proofmark.workspace import settle

_MONTH_NAME = (
    "CASE month(o_orderdate) WHEN 1 THEN 'Januari' WHEN 2 THEN 'February' WHEN 3 THEN 'Maret' "
    "WHEN 4 THEN 'April' WHEN 5 THEN 'Mei' WHEN 6 THEN 'June' WHEN 7 THEN 'Juli' WHEN 8 THEN 'August' "
    "WHEN 9 THEN 'September' WHEN 10 THEN 'Oktober' WHEN 11 THEN 'November' ELSE 'December' END"
)
_TEXT = (
    "CASE o_orderkey % 10 "
    "WHEN 0 THEN 'Berapa missing value, ' || o_orderpriority || '?' "
    f"WHEN 1 THEN 'Mengapa totalprice turun pada ' || {_MONTH_NAME} || ' berdasarkan prioritas?' "
    "WHEN 2 THEN 'Segmen mana paling tinggi berdasarkan c_acctbal untuk HOUSEHOLD atau MACHINERY?' "
    "WHEN 3 THEN 'Tampilkan o_custkey per status untuk ' || o_orderpriority || '.' "
    "WHEN 4 THEN 'Berapa jumlah baris ' || lower(o_orderpriority) || ' dan click?' "
    "WHEN 5 THEN 'Berapa rata-rata c_acctbal Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ' untuk purchase?' "
    f"WHEN 6 THEN 'Is growth in ' || {_MONTH_NAME} || ' above May, by priority or tipe?' "
    "WHEN 7 THEN 'Discount strata and ' || o_orderstatus || ' total' "
    "WHEN 8 THEN 'Top segment, compared with ' || o_orderpriority "
    "ELSE 'Ringkas value untuk signup dan ' || o_orderpriority || 'X' END"
)
_DATASET = "CASE o_custkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'customer' ELSE 'events' END"
_QUESTIONS = f"(SELECT o_orderkey AS question_id, {_DATASET} AS dataset_id, {_TEXT} AS text FROM orders)"

_EXTRA_WORDS = [("prioritas", "priority"), ("priority", "priority"), ("status", "status"), ("tipe", "type")]
_NUMERIC = {
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice"),
    "customer": (["c_custkey", "c_nationkey", "c_acctbal"], "c_custkey"),
    "events": (["event_id", "user_id", "value"], "value"),
}
_NAMES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def _questions(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(
        F.col("o_orderkey").alias("question_id"),
        F.expr(_DATASET).alias("dataset_id"),
        F.expr(_TEXT).alias("text"),
    )


def _schema_rows(spark, d):
    parts = [q.schema_catalog(name, table(spark, d, name)) for name in _NAMES]
    return q.fold_catalog(reduce(DataFrame.unionByName, parts), _EXTRA_WORDS)


def _full_catalog(spark, d):
    parts = [q.question_catalog(name, table(spark, d, name)) for name in _NAMES]
    return settle(reduce(DataFrame.unionByName, parts), "catalog")


def _values(spark, d):
    return reduce(DataFrame.unionByName, [q.value_index(name, table(spark, d, name)) for name in _NAMES])


def _resolved(spark, d):
    return q.with_catalog(_questions(spark, d), _schema_rows(spark, d))


# --- the same rules in SQL ---------------------------------------------------------------

_NORM = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"
_METRIC_SQL = "CASE dataset_id " + " ".join(
    f"WHEN '{name}' THEN CASE "
    + " ".join(f"WHEN contains({_NORM}, '{c.replace('_', '')}') THEN '{c}'" for c in columns)
    + f" ELSE '{default}' END"
    for name, (columns, default) in _NUMERIC.items()
) + " END"
_DIMENSION_SQL = (
    "CASE WHEN dataset_id = 'customer' AND contains(lower(text), 'segmen') THEN 'c_mktsegment' "
    "WHEN dataset_id = 'orders' AND (contains(lower(text), 'prioritas') OR contains(lower(text), 'priority')) "
    "THEN 'o_orderpriority' "
    "WHEN dataset_id = 'orders' AND contains(lower(text), 'status') THEN 'o_orderstatus' "
    "WHEN dataset_id = 'events' AND contains(lower(text), 'tipe') THEN 'event_type' END"
)
_DATE_SQL = "CASE dataset_id WHEN 'orders' THEN 'o_orderdate' WHEN 'events' THEN 'ts' END"
_MONTH_SQL = (
    "GREATEST("
    + ", ".join(
        f"CASE WHEN regexp_matches(lower(text), '\\b{name}\\b') THEN {number} END"
        for name, number in MONTHS.items()
    )
    + ")"
)
_BASE_SQL = (
    f"SELECT question_id, dataset_id, text, {_METRIC_SQL} AS metric, {_DIMENSION_SQL} AS dimension, "
    f"{_DATE_SQL} AS date_column, {_MONTH_SQL} AS current_month FROM {_QUESTIONS}"
)


def _said(pattern):
    return f"regexp_matches(lower(text), '{pattern}')"


_INTENT_SQL = (
    f"CASE WHEN {_said(QUALITY_PATTERN)} THEN 'quality' "
    f"WHEN date_column IS NOT NULL AND current_month IS NOT NULL AND {_said(COMPARISON_PATTERN)} THEN 'comparison' "
    f"WHEN {_said(TOP_PATTERN)} AND dimension IS NOT NULL THEN 'top' "
    "WHEN dimension IS NOT NULL THEN 'grouped' "
    f"WHEN {_said(COUNT_PATTERN)} THEN 'count' WHEN {_said(MEAN_PATTERN)} THEN 'average' ELSE 'total' END"
)
# All texts of all text columns; per question and column the longest one named, then the first.
_VALUES_SQL = union_sql(
    [
        f"SELECT DISTINCT '{name}' AS dataset_id, '{c}' AS column_name, {i} AS column_order, {c} AS v "
        f"FROM {name} WHERE length({c}) >= 3"
        for name, columns in _NAMES.items()
        for i, c in enumerate(columns)
        if c in ("o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment", "event_type", "props")
    ]
)
_FILTERS_SQL = (
    f"vals AS ({_VALUES_SQL}), "
    "asked AS (SELECT DISTINCT dataset_id, text FROM questions), "
    "hits AS (SELECT q.dataset_id, q.text, s.column_name, s.column_order, s.v, ROW_NUMBER() OVER ("
    "PARTITION BY q.dataset_id, q.text, s.column_name ORDER BY length(s.v) DESC, s.v) AS p FROM asked q "
    "JOIN vals s ON q.dataset_id = s.dataset_id AND contains(lower(q.text), lower(s.v)) "
    "AND regexp_matches(lower(q.text), '\\b' || regexp_escape(lower(s.v)) || '\\b')), "
    "named AS (SELECT dataset_id, text, string_agg(column_name || '=' || v, ';' ORDER BY column_order) AS filters, "
    "string_agg(column_name, ',' ORDER BY column_order) AS filter_columns FROM hits WHERE p = 1 GROUP BY ALL), "
    "found AS (SELECT q.question_id, n.filters, n.filter_columns FROM questions q "
    "JOIN named n ON q.dataset_id = n.dataset_id AND q.text = n.text)"
)


@query(
    "normalize_text",
    "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS normalized FROM documents",
)
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", q.normalize_text(F.col("text")).alias("normalized"))


@query("resolve_metric", f"SELECT question_id, metric FROM ({_BASE_SQL})")
def resolve_metric(spark, d):
    return _resolved(spark, d).select("question_id", q.resolve_metric().alias("metric"))


@query("resolve_dimension", f"SELECT question_id, dimension FROM ({_BASE_SQL})")
def resolve_dimension(spark, d):
    return _resolved(spark, d).select("question_id", q.resolve_dimension().alias("dimension"))


@query("resolve_date_column", f"SELECT question_id, date_column FROM ({_BASE_SQL})")
def resolve_date_column(spark, d):
    return _resolved(spark, d).select("question_id", "date_column")


@query(
    "resolve_value_filters",
    f"WITH questions AS (SELECT * FROM {_QUESTIONS}), {_FILTERS_SQL} "
    "SELECT q.question_id, COALESCE(f.filters, '') AS filters FROM questions q "
    "LEFT JOIN found f ON q.question_id = f.question_id",
)
def resolve_value_filters(spark, d):
    joined = q.with_filters(_questions(spark, d), _values(spark, d))
    pairs = F.transform("filters", lambda f: F.concat(f["column"], F.lit("="), f["value"]))
    return joined.select("question_id", F.array_join(pairs, ";").alias("filters"))


@query("resolve_months", f"SELECT question_id, CAST(current_month AS INTEGER) AS current_month FROM ({_BASE_SQL})")
def resolve_months(spark, d):
    return _questions(spark, d).select("question_id", q.resolve_month(F.lower("text")).alias("current_month"))


@query(
    "latest_year",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST(year(MAX({c})) AS INTEGER) AS year FROM {t}"
            for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
        ]
    ),
)
def latest_year(spark, d):
    ends = [date_ranges(table(spark, d, t)) for t in ("orders", "lineitem", "events")]
    year = F.regexp_extract("end", r"^(\d{4})", 1).try_cast("int")
    return reduce(DataFrame.unionByName, ends).select("column", year.alias("year"))


@query("classify_intent", f"SELECT question_id, {_INTENT_SQL} AS intent FROM ({_BASE_SQL})")
def classify_intent(spark, d):
    return q.plan_questions(_questions(spark, d), _schema_rows(spark, d)).select("question_id", "intent")


_ALL_NAMES_SQL = "CASE dataset_id " + " ".join(
    f"WHEN '{name}' THEN '{','.join(columns)}'" for name, columns in _NAMES.items()
) + " END"


@query(
    "required_columns",
    f"WITH questions AS (SELECT * FROM {_QUESTIONS}), {_FILTERS_SQL}, "
    f"r AS (SELECT *, {_INTENT_SQL} AS intent FROM ({_BASE_SQL})), "
    "j AS (SELECT r.*, f.filter_columns FROM r LEFT JOIN found f ON r.question_id = f.question_id), "
    f"t AS (SELECT question_id, CASE intent WHEN 'quality' THEN {_ALL_NAMES_SQL} "
    "WHEN 'comparison' THEN concat_ws(',', date_column, metric, dimension, filter_columns) "
    "WHEN 'count' THEN filter_columns ELSE concat_ws(',', metric, dimension, filter_columns) END AS names FROM j) "
    # A filter on the breakdown column itself must not repeat its name.
    "SELECT question_id, COALESCE(array_to_string(list_filter(string_split(names, ','), "
    "lambda x, i: list_position(string_split(names, ','), x) = i), ','), '') AS required_columns FROM t",
)
def required_columns(spark, d):
    plans = q.plan_questions(_questions(spark, d), _schema_rows(spark, d), _values(spark, d))
    return plans.select("question_id", F.array_join("required_columns", ",").alias("required_columns"))


_REQUIRED_SQL = (
    f"t AS (SELECT question_id, CASE intent WHEN 'quality' THEN {_ALL_NAMES_SQL} "
    "WHEN 'comparison' THEN concat_ws(',', date_column, metric, dimension, filter_columns) "
    "WHEN 'count' THEN filter_columns ELSE concat_ws(',', metric, dimension, filter_columns) END AS names FROM j)"
)


@query(
    "plan_questions",
    f"WITH questions AS (SELECT * FROM {_QUESTIONS}), {_FILTERS_SQL}, "
    f"r AS (SELECT *, {_INTENT_SQL} AS intent FROM ({_BASE_SQL})), "
    "j AS (SELECT r.*, f.filters, f.filter_columns FROM r LEFT JOIN found f ON r.question_id = f.question_id), "
    f"{_REQUIRED_SQL}, "
    "y AS (SELECT 'orders' AS dataset_id, CAST(year(MAX(o_orderdate)) AS INTEGER) AS year FROM orders "
    "UNION ALL SELECT 'events', CAST(year(MAX(ts)) AS INTEGER) FROM events) "
    "SELECT j.question_id, j.dataset_id, j.text, j.intent, "
    "CASE j.intent WHEN 'quality' THEN 'quality' WHEN 'comparison' THEN 'comparison' ELSE 'aggregate' END AS answer_type, "
    "CASE WHEN j.intent = 'quality' THEN 'missing_values' WHEN j.intent = 'comparison' AND j.dimension IS NOT NULL "
    "THEN 'monthly_comparison,segment_contribution' WHEN j.intent = 'comparison' THEN 'monthly_comparison' "
    "WHEN j.intent = 'top' THEN 'top_segments' WHEN j.intent = 'grouped' THEN 'grouped_aggregate' "
    "ELSE 'aggregate' END AS evidence_keys, j.metric, j.dimension AS breakdown, j.date_column, y.year, "
    "CAST(j.current_month AS INTEGER) AS current_month, "
    "CAST(CASE WHEN j.current_month = 1 THEN 12 ELSE j.current_month - 1 END AS INTEGER) AS previous_month, "
    "COALESCE(j.filters, '') AS filters, COALESCE(array_to_string(list_filter(string_split(t.names, ','), "
    "lambda x, i: list_position(string_split(t.names, ','), x) = i), ','), '') AS required_columns "
    "FROM j JOIN t ON j.question_id = t.question_id LEFT JOIN y ON j.dataset_id = y.dataset_id",
)
def plan_questions(spark, d):
    """Plans with their lists as text."""
    folded = q.fold_catalog(_full_catalog(spark, d), _EXTRA_WORDS)
    plans = q.plan_questions(_questions(spark, d), folded, _values(spark, d))
    pairs = F.transform("filters", lambda f: F.concat(f["column"], F.lit("="), f["value"]))
    return plans.withColumns(
        {
            "evidence_keys": F.array_join("evidence_keys", ","),
            "filters": F.array_join(pairs, ";"),
            "required_columns": F.array_join("required_columns", ","),
        }
    )


@query("answer_question")
def answer_question(spark, d):
    """One question answered over all orders: its evidence rows beside the answer text."""
    answer = answer_one(
        table(spark, d, "orders"),
        "Why did totalprice decline in April by priority?",
        extra_dimension_words=_EXTRA_WORDS,
    )
    return answer.plan.queries[-1].frame.withColumn("answer", F.lit(answer.text))
