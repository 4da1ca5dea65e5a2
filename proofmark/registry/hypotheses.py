"""Statistics."""

from pyspark.sql import functions as F

from proofmark.functions.normality import CENTRE, FIRST_WEIGHT, MIDDLE, SECOND_WEIGHT, TAIL
from proofmark.operators import statistics as s
from proofmark.operators.ordering import average_rank, exact_medians
from proofmark.operators.statistics_runs import run_requests
from proofmark.plans.questions import schema_catalog
from proofmark.plans.wording import STATISTICS_ERRORS
from proofmark.registry.base import fixed, query, table, union_sql
from proofmark.workspace import settle

# F against O line items: a whole table with two groups.
_LINES = "(SELECT l_linestatus AS label, l_extendedprice AS value FROM lineitem)"


def _moments_sql(source):
    """Struct-free moments of both groups in one row (a = first label, b = second)."""
    return (
        f"WITH v AS (SELECT * FROM {source}), g AS (SELECT label, COUNT(*) AS n, AVG(value) AS mean, "
        "VAR_SAMP(value) AS variance FROM v GROUP BY 1), "
        "s AS (SELECT a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.variance AS v1, b.variance AS v2 "
        "FROM g a JOIN g b ON a.label < b.label) "
    )


def _sides(spark, d):
    return s.paired_groups(
        settle(s.group_descriptives(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"), "groups")
    )


@query(
    "select_test",
    "WITH r AS (SELECT o_orderkey AS request_id, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'Auto' WHEN 2 THEN 'correlation' ELSE 'auto' END AS method, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 'o_totalprice' END AS outcome, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 'o_orderstatus' END AS \"group\", "
    "CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'o_orderkey' WHEN 1 THEN 'o_orderstatus' END END AS x, "
    "CASE WHEN o_orderkey % 4 <> 0 THEN 'o_totalprice' END AS y FROM orders) "
    "SELECT request_id, CASE WHEN lower(method) = 'correlation' THEN 'correlation' "
    "WHEN outcome IS NOT NULL AND \"group\" IS NOT NULL THEN 'compare_groups' "
    "WHEN x = 'o_orderkey' AND y IS NOT NULL THEN 'correlation' "
    "WHEN x IS NOT NULL AND y IS NOT NULL THEN 'chi_square' END AS selected FROM r",
)
def select_test(spark, d):
    """One request per order; which columns it names depends on the order."""
    orders = table(spark, d, "orders")
    kind, named = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.lit("orders").alias("dataset_id"),
        F.when(kind == 1, "Auto").when(kind == 2, "correlation").otherwise("auto").alias("method"),
        F.when(kind == 0, "o_totalprice").alias("outcome"),
        F.when(kind == 0, "o_orderstatus").alias("group"),
        F.when(kind != 0, F.when(named == 0, "o_orderkey").when(named == 1, "o_orderstatus")).alias("x"),
        F.when(kind != 0, "o_totalprice").alias("y"),
    )
    return s.select_test(requests, schema_catalog("orders", orders)).select("request_id", "selected")


@query(
    "group_descriptives",
    "SELECT l_returnflag AS label, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 4) AS mean, "
    "ROUND(MEDIAN(l_extendedprice), 4) AS median, ROUND(VAR_SAMP(l_extendedprice), 2) AS variance "
    "FROM lineitem GROUP BY 1",
)
def group_descriptives(spark, d):
    found = s.group_descriptives(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return found.select(
        "label", "n", fixed("mean", 4).alias("mean"), fixed("median", 4).alias("median"),
        fixed("variance", 2).alias("variance"),
    )


@query(
    "group_guards",
    "WITH g AS (SELECT l_orderkey, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) "
    "SELECT l_orderkey, COUNT(*) AS group_count, CASE WHEN COUNT(*) <> 2 "
    f"THEN '{STATISTICS_ERRORS['two_groups']}' WHEN MIN(n) < 3 THEN '{STATISTICS_ERRORS['group_size']}' END AS reason "
    "FROM g GROUP BY 1",
)
def group_guards(spark, d):
    """One test per order, thousands at once: which of them are admissible."""
    described = s.group_descriptives(
        table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus", ["l_orderkey"]
    )
    return s.paired_groups(described, ["l_orderkey"]).select("l_orderkey", "group_count", "reason")


def _horner_sql(coefficients, x):
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * ({x}) + {c!r}::DOUBLE)"
    return text


def _quantile_sql(p):
    """The rational normal quantile of AS 241."""
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    parts = [
        f"{_horner_sql(form[0], x)} / {_horner_sql(form[1], x)}"
        for form, x in ((CENTRE, f"0.180625 - {q} * {q}"), (MIDDLE, f"{r} - 1.6"), (TAIL, f"{r} - 5.0"))
    ]
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {parts[0]} "
        f"WHEN {r} <= 5.0 THEN sign({q}) * {parts[1]} ELSE sign({q}) * {parts[2]} END"
    )


# Groups here have more than five values each, so both corrected weights apply.
_SHAPIRO_SQL = (
    "WITH v AS (SELECT event_type AS label, value - AVG(value) OVER (PARTITION BY event_type) AS x, "
    "COUNT(*) OVER (PARTITION BY event_type) AS n, "
    "ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) AS i FROM events), "
    "q AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM v), "
    f"m AS (SELECT label, n, i, x, {_quantile_sql('p')} AS m FROM q), "
    "g AS (SELECT label, n, SUM(m * x) AS mx, SUM(m * m) AS mm, SUM(x * x) AS xx, "
    "MAX(x) FILTER (WHERE i = n) - MAX(x) FILTER (WHERE i = 1) AS d1, "
    "MAX(x) FILTER (WHERE i = n - 1) - MAX(x) FILTER (WHERE i = 2) AS d2, "
    "MAX(m) FILTER (WHERE i = n) AS m1, MAX(m) FILTER (WHERE i = n - 1) AS m2 FROM m GROUP BY label, n), "
    f"a AS (SELECT *, m1 / sqrt(mm) + {_horner_sql(FIRST_WEIGHT, '1.0 / sqrt(n)')} AS a1, "
    f"m2 / sqrt(mm) + {_horner_sql(SECOND_WEIGHT, '1.0 / sqrt(n)')} AS a2 FROM g) "
    "SELECT label, n, ROUND(least(1.0, power(a1 * d1 + a2 * d2 + (mx - m1 * d1 - m2 * d2) "
    "/ sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / xx), 6) AS shapiro_w FROM a"
)


@query("shapiro_wilk", _SHAPIRO_SQL)
def shapiro_wilk(spark, d):
    values = s.group_values(table(spark, d, "events"), "value", "event_type")
    found = s.shapiro_by_group(values, ["label"])
    return found.select("label", "n", fixed("shapiro_w").alias("shapiro_w"))


@query(
    "levene_median",
    f"WITH v AS (SELECT * FROM {_LINES}), m AS (SELECT label, MEDIAN(value) AS med FROM v GROUP BY 1), "
    "z AS (SELECT v.label, ABS(v.value - m.med) AS z FROM v JOIN m ON v.label = m.label), "
    "g AS (SELECT label, COUNT(*) AS n, AVG(z) AS zm, VAR_POP(z) AS zv FROM z GROUP BY 1), "
    "t AS (SELECT COUNT(*) AS k, SUM(n) AS total, SUM(n * zm) AS sz, SUM(n * zm * zm) AS szz, SUM(n * zv) AS w FROM g) "
    "SELECT CAST(total AS BIGINT) AS n, ROUND((total - k) * (szz - sz * sz / total) / ((k - 1) * w), 4) AS levene_w FROM t",
)
def levene_median(spark, d):
    lines = table(spark, d, "lineitem")
    described = settle(s.group_descriptives(lines, "l_extendedprice", "l_linestatus"), "groups")
    found = s.levene_median(s.group_values(lines, "l_extendedprice", "l_linestatus"), described)
    return found.select("n", fixed("levene_w", 4).alias("levene_w"))


@query(
    "welch_t_test",
    _moments_sql(_LINES)
    + "SELECT ROUND((m1 - m2) / SQRT(v1 / n1 + v2 / n2), 6) AS statistic, "
    "ROUND(POWER(v1 / n1 + v2 / n2, 2) / (POWER(v1 / n1, 2) / (n1 - 1) + POWER(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM s",
)
def welch_t_test(spark, d):
    found = s.welch_t_test(_sides(spark, d))
    return found.select(fixed("statistic").alias("statistic"), fixed("df", 4).alias("df"))


@query(
    "cohens_d",
    _moments_sql(_LINES)
    + "SELECT ROUND((m1 - m2) / SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS effect_size FROM s",
)
def cohens_d(spark, d):
    return _sides(spark, d).select(fixed(s.cohens_d()).alias("effect_size"))


_RANKED_SQL = (
    f"WITH v AS (SELECT * FROM {_LINES}), r AS (SELECT label, value, "
    "RANK() OVER (ORDER BY value) + (COUNT(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM v), "
    "u AS (SELECT COUNT(*) FILTER (WHERE label = 'F') AS n1, COUNT(*) FILTER (WHERE label = 'O') AS n2, "
    "SUM(rank) FILTER (WHERE label = 'F') AS r1 FROM r), "
    "t AS (SELECT SUM(n * n * n - n) AS ties FROM (SELECT COUNT(*) AS n FROM v GROUP BY value)) "
)


def _mann_whitney(spark, d):
    values = s.group_values(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")
    sizes = values.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return s.mann_whitney_u(values, settle(s.paired_groups(sizes), "sides"))


@query(
    "mann_whitney_u",
    _RANKED_SQL
    + "SELECT n1, n2, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS statistic, CAST(ties AS DOUBLE) AS tie_term FROM u, t",
)
def mann_whitney_u(spark, d):
    return _mann_whitney(spark, d).select("n1", "n2", "statistic", "tie_term")


@query(
    "rank_biserial",
    _RANKED_SQL + "SELECT ROUND(2.0 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) AS effect_size FROM u",
)
def rank_biserial(spark, d):
    return _mann_whitney(spark, d).select(fixed("effect_size").alias("effect_size"))


@query(
    "compare_groups",
    _RANKED_SQL
    + ", m AS (SELECT AVG(value) FILTER (WHERE label = 'F') AS m1, AVG(value) FILTER (WHERE label = 'O') AS m2, "
    "MEDIAN(value) FILTER (WHERE label = 'F') AS d1, MEDIAN(value) FILTER (WHERE label = 'O') AS d2 FROM v) "
    "SELECT 'mann_whitney_u' AS method, 'F' AS first_group, 'O' AS second_group, n1, n2, "
    "ROUND(m1, 4) AS mean1, ROUND(m2, 4) AS mean2, ROUND(d1, 4) AS median1, ROUND(d2, 4) AS median2, "
    "CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS statistic, false AS normality_passed, "
    "ROUND(2.0 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) AS effect_size FROM u, m",
)
def compare_groups(spark, d):
    found = s.compare_groups(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")
    at = lambda name, i: F.get(name, F.lit(i))
    return found.select(
        "method",
        at("groups", 0).alias("first_group"),
        at("groups", 1).alias("second_group"),
        at("sample_sizes", 0).alias("n1"),
        at("sample_sizes", 1).alias("n2"),
        fixed(at("means", 0), 4).alias("mean1"),
        fixed(at("means", 1), 4).alias("mean2"),
        fixed(at("medians", 0), 4).alias("median1"),
        fixed(at("medians", 1), 4).alias("median2"),
        "statistic",
        "normality_passed",
        fixed("effect_size").alias("effect_size"),
    )


@query(
    "pearson",
    "SELECT COUNT(*) AS sample_size, ROUND(CORR(l_quantity, l_extendedprice), 6) AS coefficient FROM lineitem",
)
def pearson(spark, d):
    found = s.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select("sample_size", fixed("coefficient").alias("coefficient"))


@query(
    "spearman",
    "WITH r AS (SELECT RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, "
    "RANK() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem) "
    "SELECT COUNT(*) AS sample_size, ROUND(CORR(rx, ry), 6) AS coefficient FROM r",
)
def spearman(spark, d):
    found = s.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select("sample_size", fixed("coefficient").alias("coefficient"))


@query(
    "average_rank",
    "WITH c AS (SELECT value, COUNT(*) AS n FROM events GROUP BY 1) "
    "SELECT value, n, CAST(SUM(n) OVER (ORDER BY value) - n AS DOUBLE) + (n + 1) / 2.0 AS avg_rank FROM c",
)
def average_rank_query(spark, d):
    return average_rank(table(spark, d, "events"), "value")


@query(
    "exact_median",
    "SELECT l_suppkey, COUNT(l_extendedprice) AS n, ROUND(MEDIAN(l_extendedprice), 4) AS median "
    "FROM lineitem GROUP BY 1",
)
def exact_median(spark, d):
    found = exact_medians(table(spark, d, "lineitem"), ["l_extendedprice"], ["l_suppkey"])
    return found.select("l_suppkey", "n", fixed("median", 4).alias("median"))


_CELLS_SQL = (
    "WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, COUNT(*) AS observed FROM orders GROUP BY 1, 2), "
    "e AS (SELECT *, SUM(observed) OVER (PARTITION BY x) AS row_total, SUM(observed) OVER (PARTITION BY y) AS column_total, "
    "SUM(observed) OVER () AS total FROM c), "
    "f AS (SELECT *, CAST(row_total AS DOUBLE) * column_total / total AS expected FROM e), "
    "k AS (SELECT COUNT(DISTINCT x) AS r, COUNT(DISTINCT y) AS q, MAX(total) AS n, "
    "SUM((observed - expected) * (observed - expected) / expected) AS chi, MIN(expected) AS least FROM f) "
)


@query(
    "contingency_table",
    _CELLS_SQL + "SELECT x, y, observed, CAST(row_total AS BIGINT) AS row_total, "
    "CAST(column_total AS BIGINT) AS column_total, CAST(total AS BIGINT) AS total, ROUND(expected, 6) AS expected FROM f",
)
def contingency_table(spark, d):
    found = s.contingency_table(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return found.withColumn("expected", fixed("expected"))


@query(
    "crosstab",
    "SELECT o_orderpriority AS x, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS F, "
    "COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS O, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS P "
    "FROM orders GROUP BY 1",
)
def crosstab(spark, d):
    return s.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


# quality against toxic is 2 x 2, so the continuity correction applies.
@query(
    "chi_square",
    "WITH c AS (SELECT quality AS x, toxic AS y, COUNT(*) AS observed FROM labels GROUP BY 1, 2), "
    "e AS (SELECT *, CAST(SUM(observed) OVER (PARTITION BY x) AS DOUBLE) * SUM(observed) OVER (PARTITION BY y) "
    "/ SUM(observed) OVER () AS expected FROM c) "
    "SELECT 'labels' AS dataset, CAST(SUM(observed) AS BIGINT) AS sample_size, "
    "ROUND(SUM(POWER(ABS(observed - expected) - LEAST(0.5, ABS(observed - expected)), 2) / expected), 6) AS statistic, "
    "CAST(1 AS BIGINT) AS degrees_of_freedom FROM e UNION ALL "
    + "SELECT 'orders', n, chi, dof FROM ("
    + _CELLS_SQL
    + "SELECT CAST(n AS BIGINT) AS n, ROUND(chi, 6) AS chi, (r - 1) * (q - 1) AS dof FROM k)",
)
def chi_square(spark, d):
    square = s.chi_square_statistics(table(spark, d, "labels"), "quality", "toxic")
    larger = s.chi_square_statistics(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    both = square.withColumn("dataset", F.lit("labels")).unionByName(larger.withColumn("dataset", F.lit("orders")))
    return both.select("dataset", "sample_size", fixed("statistic").alias("statistic"), "degrees_of_freedom")


@query("cramers_v", _CELLS_SQL + "SELECT ROUND(SQRT(chi / (n * GREATEST(LEAST(r, q) - 1, 1))), 6) AS cramers_v FROM k")
def cramers_v(spark, d):
    found = s.chi_square_statistics(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return found.select(fixed("cramers_v").alias("cramers_v"))


@query("min_expected_count", _CELLS_SQL + "SELECT ROUND(least, 6) AS minimum_expected_count FROM k")
def min_expected_count(spark, d):
    found = s.chi_square_statistics(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return found.select(fixed("minimum_expected_count").alias("minimum_expected_count"))


# Requests on the orders: one that succeeds and one for every reason to fail.
_REQUESTS = (
    {"method": "chi_square", "x": "o_orderstatus", "y": "o_orderpriority"},
    {"method": "anova", "x": "o_orderstatus", "y": "o_orderpriority"},
    {"method": "auto", "outcome": "o_totalprice"},
    {"method": "compare_groups", "outcome": "o_totalprice", "group": "o_orderpriority"},
    {"method": "correlation", "x": "o_totalprice", "y": "no_such_column"},
    {"method": "auto", "x": "o_orderpriority", "y": "o_orderstatus"},
)
_FAILED = (
    (2, "anova", STATISTICS_ERRORS["method"] + "anova"),
    (3, "auto", STATISTICS_ERRORS["auto"]),
    (4, "compare_groups", STATISTICS_ERRORS["two_groups"]),
    (5, "correlation", STATISTICS_ERRORS["columns"] + "no_such_column"),
)


# Three states and five priorities: eight degrees of freedom, whose tail is a finite sum.
@query(
    "statistics_report",
    _CELLS_SQL
    + ", d AS (SELECT chi / 2 AS h, CAST((r - 1) * (q - 1) // 2 AS BIGINT) AS terms FROM k), "
    "p AS (SELECT SUM(EXP(-h) * POWER(h, i) / factorial(CAST(i AS INTEGER))) AS p FROM "
    "(SELECT h, UNNEST(range(terms)) AS i FROM d)) "
    "SELECT CAST(position AS BIGINT) AS position, requested, 'chi_square' AS method, 'completed' AS status, "
    "ROUND(p, 9) AS p_value, p < 0.05 AS significant, 'Metode chi_square; p-value=' || format('{:.6g}', p) "
    "|| '; significant=' || CASE WHEN p < 0.05 THEN 'True' ELSE 'False' END || '.' AS answer, NULL AS error "
    "FROM p, (VALUES (1, 'chi_square'), (6, 'auto')) v(position, requested) UNION ALL "
    + union_sql(
        [f"SELECT {i}, '{method}', NULL, 'failed', NULL, NULL, NULL, '{reason}'" for i, method, reason in _FAILED]
    ),
)
def statistics_report(spark, d):
    runs = run_requests(table(spark, d, "orders"), _REQUESTS)
    return runs.select(
        "position", "requested", "method", "status", fixed("p_value", 9).alias("p_value"), "significant",
        "answer", "error",
    )


# Far more than a thousand degrees of freedom: the quantile of t by its expansion around the
# normal one (1.959963984540054 for 95 %), and p by nothing SQL has, so it is left to the tests.
_Z = 1.959963984540054


@query(
    "welch_confidence_interval",
    _moments_sql(_LINES)
    + ", w AS (SELECT m1 - m2 AS gap, SQRT(v1 / n1 + v2 / n2) AS error, POWER(v1 / n1 + v2 / n2, 2) / "
    "(POWER(v1 / n1, 2) / (n1 - 1) + POWER(v2 / n2, 2) / (n2 - 1)) AS df FROM s), "
    f"c AS (SELECT *, {_Z} + {(_Z**3 + _Z) / 4!r} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (df * df) AS t FROM w) "
    "SELECT ROUND(gap - t * error, 4) AS ci_low, ROUND(gap + t * error, 4) AS ci_high FROM c",
)
def welch_confidence_interval(spark, d):
    found = s.welch_t_test(_sides(spark, d))
    return found.select(*[fixed(c, 4).alias(c) for c in ("ci_low", "ci_high")])
