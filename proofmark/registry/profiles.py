"""Profiling."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmark.operators import profile as p
from proofmark.operators.selection import exact_numbers
from proofmark.plans.wording import PII_NAME_PARTS, TARGET_NAME_PARTS, WARNINGS
from proofmark.registry.base import (
    LABELLED_SQL,
    fixed,
    labelled_documents,
    query,
    table,
    union_sql,
)

_DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def _per_column(columns, template, source):
    return f"WITH t AS (SELECT * FROM {source}) " + union_sql([template.format(c=c) for c in columns])


# Types as the tables carry them.
_SCHEMAS = {
    "orders": (
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ),
    "documents": (
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
        ("n_chars", "bigint"),
    ),
    "labels": (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")),
    "embeddings": (("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")),
}


@query(
    "profile_schema",
    union_sql(
        [
            f"SELECT '{t}' AS dataset_id, CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{kind}' AS type, "
            f"true AS nullable, COUNT(*) - COUNT({c}) AS missing_count FROM {t}"
            for t, columns in _SCHEMAS.items()
            for i, (c, kind) in enumerate(columns)
        ]
    ),
)
def profile_schema(spark, d):
    """The schema rows beside what is missing in each column."""
    parts = []
    for name in _SCHEMAS:
        df = table(spark, d, name)
        gaps = p.missing(df).select("column", "missing_count")
        parts.append(p.profile_schema(df).join(gaps, "column").select(F.lit(name).alias("dataset_id"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query("profile_row_count", "SELECT COUNT(*) AS row_count FROM lineitem")
def profile_row_count(spark, d):
    return p.row_count(table(spark, d, "lineitem"))


@query(
    "profile_duplicates",
    "WITH g AS (SELECT text, lang, source, n_chars, COUNT(*) AS n FROM documents GROUP BY ALL) "
    "SELECT CAST(SUM(n) AS BIGINT) AS row_count, CAST(SUM(n - 1) AS BIGINT) AS duplicate_count, "
    "CAST(SUM(n - 1) AS DOUBLE) / SUM(n) AS duplicate_rate FROM g",
)
def profile_duplicates(spark, d):
    return p.duplicates(table(spark, d, "documents").drop("doc_id"))


@query(
    "profile_missing",
    _per_column(
        _DOC_COLUMNS,
        "SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, COUNT(*) AS row_count, "
        "CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) AS missing_rate FROM t",
        LABELLED_SQL,
    ),
)
def profile_missing(spark, d):
    return p.missing(labelled_documents(spark, d))


@query(
    "profile_distinct",
    _per_column(
        _DOC_COLUMNS,
        "SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS distinct_count FROM t",
        LABELLED_SQL,
    ),
)
def profile_distinct(spark, d):
    return p.distinct(labelled_documents(spark, d))


@query("profile_distinct_approx")
def profile_distinct_approx(spark, d):
    return p.distinct_approx(table(spark, d, "lineitem"))


_CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "profile_samples",
    "WITH v AS ("
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS n "
            f"FROM customer WHERE {c} IS NOT NULL GROUP BY 2"
            for c in _CUSTOMER_COLUMNS
        ]
    )
    + "), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS position FROM v) "
    "SELECT * FROM r WHERE position <= 5",
)
def profile_samples(spark, d):
    return p.samples(table(spark, d, "customer"))


_LINE_VALUES = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")


@query(
    "frequent_values",
    "WITH v AS ("
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS n "
            f"FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2"
            for c in _LINE_VALUES
        ]
    )
    + "), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS position FROM v) "
    "SELECT * FROM r WHERE position <= 5",
)
def frequent_values(spark, d):
    """Found by summaries and bucket bounds: flat, falling and hot columns of the line items."""
    return p.samples(table(spark, d, "lineitem").select(*_LINE_VALUES))


_LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax",
)


@query(
    "profile_numeric",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, "
            f"ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_POP({c}), 4) AS stddev, "
            f"ROUND(CAST(MEDIAN({c}) AS DOUBLE), 4) AS median FROM lineitem"
            for c in _LINE_NUMBERS
        ]
    ),
)
def profile_numeric(spark, d):
    found = p.numeric_summary(table(spark, d, "lineitem"))
    return found.select("column", "min", "max", *[fixed(c, 4).alias(c) for c in ("mean", "stddev", "median")])


# Numbers of the orders that no double can hold, beside some that it can.
_EXACT = {
    "o_orderkey": ("o_orderkey", "o_orderkey"),
    "o_totalprice": ("o_totalprice", "o_totalprice"),
    "beyond_doubles": ("o_orderkey + 9007199254740993",) * 2,
    "signed": ("IF(o_custkey % 2 = 0, -1, 1) * (o_orderkey + 9007199254740993)",
               "CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey + 9007199254740993)"),
    "many_digits": (
        "CAST(CAST(o_custkey AS DECIMAL(17,0)) * CAST('100000000000000000000' AS DECIMAL(21,0)) "
        "+ o_orderkey AS DECIMAL(38,0))",
        "CAST(o_custkey AS HUGEINT) * CAST(100000000000000000000 AS HUGEINT) + o_orderkey",
    ),
}


@query(
    "profile_numeric_exact",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", COUNT(*) AS n, CAST(MIN(v) AS VARCHAR) AS min, CAST(MAX(v) AS VARCHAR) AS max, "
            "CAST(MAX(v) FILTER (r = (n - 1) // 2 + 1) AS VARCHAR) AS lower_median, "
            "CAST(MAX(v) FILTER (r = n // 2 + 1) AS VARCHAR) AS upper_median FROM "
            f"(SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS r, COUNT(*) OVER () AS n FROM (SELECT {sql} AS v FROM orders))"
            for c, (_, sql) in _EXACT.items()
        ]
    ),
)
def profile_numeric_exact(spark, d):
    """Every digit of minima, maxima and both middle values."""
    orders = table(spark, d, "orders")
    return exact_numbers(
        orders.select(*[F.expr(e).alias(c) for c, (e, _) in _EXACT.items()])
    ).drop("median")


@query(
    "profile_date_range",
    "SELECT 'o_orderdate' AS \"column\", CAST(MIN(o_orderdate) AS VARCHAR) AS \"start\", "
    "CAST(MAX(o_orderdate) AS VARCHAR) AS \"end\" FROM orders",
)
def profile_date_range(spark, d):
    return p.date_ranges(table(spark, d, "orders"))


_PERSONAL = {
    "c_custkey": "customer_id",
    "c_name": "contact_email",
    "c_nationkey": "nation",
    "c_acctbal": "revenue",
    "c_mktsegment": "segment_label",
}


def _personal(spark, d):
    """Customers under the column names a business export would have."""
    return table(spark, d, "customer").withColumnsRenamed(_PERSONAL)


def _flag_sql(flag, expression):
    return union_sql(
        [
            f"SELECT '{new}' AS \"column\", COUNT(DISTINCT {old}) AS distinct_count, "
            f"{expression.format(name=new, old=old)} AS {flag} FROM customer"
            for old, new in _PERSONAL.items()
        ]
    )


@query(
    "classify_identifiers",
    _flag_sql(
        "is_identifier",
        "lower('{name}') = 'id' OR lower('{name}') LIKE '%\\_id' ESCAPE '\\' "
        "OR CAST(COUNT(DISTINCT {old}) AS DOUBLE) / COUNT(*) >= 0.98",
    ),
)
def classify_identifiers(spark, d):
    return p.column_facts(_personal(spark, d)).select("column", "distinct_count", "is_identifier")


@query(
    "classify_pii",
    _flag_sql("is_pii", "regexp_matches('{name}', '" + "|".join(PII_NAME_PARTS) + "')"),
)
def classify_pii(spark, d):
    return p.column_facts(_personal(spark, d)).select("column", "distinct_count", "is_pii")


@query(
    "classify_targets",
    _flag_sql("is_target", "regexp_matches('{name}', '" + "|".join(TARGET_NAME_PARTS) + "')"),
)
def classify_targets(spark, d):
    return p.column_facts(_personal(spark, d)).select("column", "distinct_count", "is_target")


@query(
    "profile_warnings",
    "WITH t AS (SELECT text, lang, source AS email_source, n_chars, quality, toxic FROM "
    + LABELLED_SQL
    + "), g AS (SELECT COUNT(*) AS n FROM t GROUP BY ALL), g2 AS "
    "(SELECT text, lang, email_source, n_chars, quality, toxic, COUNT(*) AS n FROM t GROUP BY ALL), "
    "s AS (SELECT SUM(n - 1) AS dup FROM g2), "
    "m AS ("
    + union_sql(
        [
            f"SELECT {i} AS i, '{c}' AS c, CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) AS r FROM t"
            for i, c in enumerate(("text", "lang", "email_source", "n_chars", "quality", "toxic"))
        ]
    )
    + "), h AS (SELECT string_agg(c, ', ' ORDER BY i) AS names FROM m WHERE r >= 0.2) "
    "SELECT concat_ws(chr(10), "
    f"CASE WHEN dup > 0 THEN replace('{WARNINGS['duplicates']}', '%d', CAST(dup AS VARCHAR)) END, "
    f"CASE WHEN names IS NOT NULL THEN '{WARNINGS['missing']}' || names END, "
    f"'{WARNINGS['pii']}email_source') AS warnings FROM s, h",
)
def profile_warnings(spark, d):
    frame = labelled_documents(spark, d).drop("doc_id").withColumnRenamed("source", "email_source")
    found = p.warnings_row(p.column_facts(frame), p.duplicates(frame))
    return found.select(F.array_join("warnings", "\n").alias("warnings"))


@query("profile_table")
def profile_table(spark, d):
    return p.profile(labelled_documents(spark, d)).columns
