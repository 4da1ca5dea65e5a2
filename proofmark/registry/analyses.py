"""Filters, projections, aggregates and comparisons."""

from pyspark.sql import functions as F

from proofmark.functions.columns import (
    equals_all,
    in_two_months,
    null_to_zero,
    safe_ratio,
    to_number,
)
from proofmark.operators import aggregates as a
from proofmark.registry.base import (
    LABELLED_SQL,
    fixed,
    labelled_documents,
    query,
    table,
    union_sql,
)


@query(
    "filter_equals_all",
    "SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def filter_equals_all(spark, d):
    wanted = equals_all({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return table(spark, d, "orders").where(wanted).select("o_orderkey", "o_totalprice")


@query(
    "filter_month_range",
    "SELECT o_orderkey, o_orderdate FROM orders "
    "WHERE o_orderdate >= DATE '1999-12-01' AND o_orderdate < DATE '2000-02-01'",
)
def filter_month_range(spark, d):
    """January: the previous month lies in the year before."""
    orders = table(spark, d, "orders")
    return orders.where(in_two_months(F.col("o_orderdate"), 2000, 1)).select("o_orderkey", "o_orderdate")


@query(
    "filter_month_in",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE month(o_orderdate) IN (12, 1)",
)
def filter_month_in(spark, d):
    orders = table(spark, d, "orders")
    return orders.where(in_two_months(F.col("o_orderdate"), None, 1)).select("o_orderkey", "o_orderdate")


@query(
    "month_of",
    "SELECT CAST(month(l_shipdate) AS INTEGER) AS month, COUNT(*) AS row_count FROM lineitem GROUP BY 1",
)
def month_of(spark, d):
    return table(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("month")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "safe_ratio",
    "SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) "
    "/ NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS price_per_finished FROM orders GROUP BY 1",
)
def safe_ratio_query(spark, d):
    """Prices are added as decimals, so the quotient needs no rounding to compare."""
    finished = F.count_if(F.col("o_orderstatus") == "F")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        safe_ratio(total, finished).alias("price_per_finished")
    )


@query(
    "null_to_zero",
    f"SELECT doc_id, COALESCE(quality, 0) AS quality, COALESCE(toxic, 0) AS toxic FROM {LABELLED_SQL}",
)
def null_to_zero_query(spark, d):
    return labelled_documents(spark, d).select(
        "doc_id", *[null_to_zero(F.col(c)).alias(c) for c in ("quality", "toxic")]
    )


@query(
    "numeric_coerce",
    "WITH t AS (SELECT o_orderpriority, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority "
    "ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS number FROM orders) "
    "SELECT o_orderpriority, COUNT(number) AS kept, ROUND(SUM(number), 2) AS total FROM t "
    "WHERE number IS NOT NULL GROUP BY 1",
)
def numeric_coerce(spark, d):
    """Text that is a price in some rows and words in others."""
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    numbers = table(spark, d, "orders").select("o_orderpriority", to_number(text).alias("number"))
    return numbers.where(F.col("number").isNotNull()).groupBy("o_orderpriority").agg(
        F.count("number").alias("kept"), fixed(F.sum("number"), 2).alias("total")
    )


_OPEN = {"o_orderstatus": "O"}


@query(
    "total_metric",
    "SELECT ROUND(SUM(o_totalprice), 2) AS metric_value, COUNT(o_totalprice) AS non_null_count "
    "FROM orders WHERE o_orderstatus = 'O'",
)
def total_metric(spark, d):
    return a.total_metric(table(spark, d, "orders"), "o_totalprice", _OPEN).withColumn(
        "metric_value", fixed("metric_value", 2)
    )


@query(
    "average_metric",
    "SELECT ROUND(AVG(l_extendedprice), 4) AS metric_value, COUNT(l_extendedprice) AS non_null_count "
    "FROM lineitem",
)
def average_metric(spark, d):
    return a.average_metric(table(spark, d, "lineitem"), "l_extendedprice").withColumn(
        "metric_value", fixed("metric_value", 4)
    )


@query("row_count", "SELECT COUNT(*) AS row_count FROM orders WHERE o_orderstatus = 'O'")
def row_count(spark, d):
    return a.row_count(table(spark, d, "orders"), _OPEN)


@query(
    "grouped_aggregate",
    "SELECT quality AS segment, CAST(SUM(n_chars) AS BIGINT) AS metric_value, COUNT(*) AS row_count "
    f"FROM {LABELLED_SQL} GROUP BY 1",
)
def grouped_aggregate(spark, d):
    """The unlabelled documents form the NULL segment."""
    return a.grouped_aggregate(labelled_documents(spark, d), "quality", "n_chars").withColumn(
        "metric_value", F.col("metric_value").cast("bigint")
    )


@query(
    "top_segments",
    "SELECT l_suppkey AS segment, ROUND(SUM(l_extendedprice), 2) AS metric_value FROM lineitem "
    "GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10",
)
def top_segments(spark, d):
    return a.top_segments(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice").withColumn(
        "metric_value", fixed("metric_value", 2)
    )


@query(
    "conditional_sum",
    "SELECT l_returnflag, ROUND(SUM(l_quantity) FILTER (WHERE month(l_shipdate) = 4), 2) AS april_quantity "
    "FROM lineitem GROUP BY 1",
)
def conditional_sum(spark, d):
    april = F.when(F.month("l_shipdate") == 4, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(fixed(F.sum(april), 2).alias("april_quantity"))


@query(
    "conditional_count",
    f"SELECT lang, COUNT(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM {LABELLED_SQL} GROUP BY 1",
)
def conditional_count(spark, d):
    return labelled_documents(spark, d).groupBy("lang").agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"))


_APRIL = "o_orderdate >= DATE '2001-03-01' AND o_orderdate < DATE '2001-05-01'"
_MONTHLY_SQL = (
    "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, SUM(o_totalprice) AS metric_value "
    f"FROM orders WHERE {_APRIL} GROUP BY 1"
)


def _monthly(spark, d):
    return a.monthly_comparison(table(spark, d, "orders"), "o_orderdate", "o_totalprice", 4, 2001)


@query("monthly_comparison", f"SELECT month, ROUND(metric_value, 2) AS metric_value FROM ({_MONTHLY_SQL})")
def monthly_comparison(spark, d):
    return _monthly(spark, d).withColumn("metric_value", fixed("metric_value", 2))


@query(
    "segment_contribution",
    "WITH monthly AS (SELECT o_orderpriority AS segment, month(o_orderdate) AS month, "
    f"SUM(o_totalprice) AS v FROM orders WHERE {_APRIL} GROUP BY 1, 2), "
    "sides AS (SELECT segment, COALESCE(SUM(v) FILTER (WHERE month = 3), 0) AS previous_value, "
    "COALESCE(SUM(v) FILTER (WHERE month = 4), 0) AS current_value FROM monthly GROUP BY 1) "
    "SELECT segment, ROUND(previous_value, 2) AS previous_value, ROUND(current_value, 2) AS current_value, "
    "ROUND(current_value - previous_value, 2) AS delta FROM sides "
    "ORDER BY current_value - previous_value NULLS LAST, segment LIMIT 10",
)
def segment_contribution(spark, d):
    found = a.segment_contribution(
        table(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", 4, 2001
    )
    return found.select("segment", *[fixed(c, 2).alias(c) for c in ("previous_value", "current_value", "delta")])


@query(
    "change_rate",
    f"WITH m AS ({_MONTHLY_SQL}), s AS (SELECT MAX(metric_value) FILTER (WHERE month = 3) AS p, "
    "MAX(metric_value) FILTER (WHERE month = 4) AS c FROM m) "
    "SELECT ROUND(p, 2) AS previous_value, ROUND(c, 2) AS current_value, ROUND(c - p, 2) AS change, "
    "ROUND((c - p) / NULLIF(p, 0), 6) AS rate FROM s",
)
def change_rate(spark, d):
    found = a.change_rate(_monthly(spark, d), 4)
    return found.select(
        *[fixed(c, 2).alias(c) for c in ("previous_value", "current_value", "change")],
        fixed("rate").alias("rate"),
    )


_MISSING_SQL = union_sql(
    [
        f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / NULLIF(COUNT(*), 0) AS missing_rate "
        f"FROM {LABELLED_SQL}"
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    ]
)


@query("missing_values", _MISSING_SQL)
def missing_values(spark, d):
    return a.missing_values(labelled_documents(spark, d))


@query(
    "risky_columns",
    f"WITH m AS ({_MISSING_SQL}), r AS (SELECT *, COUNT(*) OVER () AS risky_count, "
    "ROW_NUMBER() OVER (ORDER BY missing_rate DESC, \"column\") AS position FROM m WHERE missing_rate > 0) "
    "SELECT * FROM r WHERE position <= 5",
)
def risky_columns(spark, d):
    return a.risky_columns(a.missing_values(labelled_documents(spark, d)))


@query(
    "top3_of_grouped",
    "WITH g AS (SELECT l_suppkey AS segment, SUM(l_quantity) AS metric_value FROM lineitem GROUP BY 1), "
    "r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY metric_value DESC NULLS LAST, segment) AS position, "
    "COUNT(*) OVER () AS segment_count FROM g) "
    "SELECT position, segment, ROUND(metric_value, 2) AS metric_value, segment_count FROM r WHERE position <= 3",
)
def top3_of_grouped(spark, d):
    grouped = a.grouped_aggregate(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return a.leading_segments(grouped).withColumn("metric_value", fixed("metric_value", 2))
