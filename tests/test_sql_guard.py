import pytest
from pyspark.errors import AnalysisException

from proofmark.operators import sql_guard as g
from proofmark.plans.wording import FORBIDDEN_SQL_FUNCTIONS, FORBIDDEN_SQL_WORDS

# Statements made from the words of the policy itself.
WORDS = (*FORBIDDEN_SQL_WORDS, *g.SPARK_FORBIDDEN_WORDS)
REFUSED = [
    *[text for text in ("", " \n ", ";", "; ;")],
    *[f"{word.upper()} dataset" for word in FORBIDDEN_SQL_WORDS],
    *[f"WITH kept AS (SELECT id FROM dataset) {word} kept" for word in FORBIDDEN_SQL_WORDS],
    *[f"select max({word}(id)) from dataset" for word in WORDS],
    *[f"SELECT n FROM {name}('place')" for name in FORBIDDEN_SQL_FUNCTIONS],
    *[f"SELECT kind{mark}FROM dataset" for mark in (" -- c\n", "/* c */", ";")],
    *[f"SELECT TRANSFORM(kind) {using}'tool' FROM dataset" for using in ("USING ", "using\n")],
    *[f"{verb} dataset" for verb in ("DESCRIBE", "SHOW COLUMNS IN", "EXPLAIN SELECT * FROM", "TABLE")],
]
ALLOWED = [
    ("SELECT * FROM dataset;", "SELECT * FROM dataset"),
    (" with t as (select 1 AS x) select * from t ", "with t as (select 1 AS x) select * from t"),
    *[(f"SELECT {word}_x FROM dataset",) * 2 for word in FORBIDDEN_SQL_WORDS],
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1000).selectExpr("id", "id % 3 AS kind")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    with pytest.raises(g.SQLPolicyError):
        g.check_sql(sql)


@pytest.mark.parametrize(("sql", "clean"), ALLOWED)
def test_allowed(sql, clean):
    assert g.check_sql(sql) == clean


def test_column_form_agrees_with_the_driver_form(spark):
    statements = [*REFUSED, *[sql for sql, _ in ALLOWED]]
    log = spark.createDataFrame([(s,) for s in statements], "sql string")
    verdicts = {r["sql"]: r["allowed"] for r in g.audit_sql(log).collect()}
    assert verdicts == {s: s not in REFUSED for s in statements}


def test_cap_and_truncation(spark, table):
    result = g.collect_guarded(spark, table, "SELECT id FROM dataset ORDER BY id DESC", cap=5)
    assert [r["id"] for r in result["rows"]] == [999, 998, 997, 996, 995]
    assert result["truncated"] and result["row_count"] == 5
    assert not g.collect_guarded(spark, table, "SELECT COUNT(*) AS n FROM dataset")["truncated"]


def test_files_and_other_tables_are_out_of_reach(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "other"))
    table.createOrReplaceTempView("secrets")
    for sql in (
        f"SELECT * FROM parquet.`{tmp_path}/other`",
        "SELECT * FROM secrets",
        "SELECT * FROM dataset a JOIN secrets b ON a.id = b.id",
        "SELECT * FROM dataset, secrets",
        "SELECT * FROM default.secrets",
        "SELECT * FROM global_temp.secrets",
        "WITH x AS (TABLE secrets) SELECT * FROM x",
        "SELECT * FROM IDENTIFIER('sec' || 'rets')",
        "SELECT id, (SELECT max(id) FROM (TABLE secrets)) AS top FROM dataset",
        "SELECT * FROM dataset WHERE id IN (SELECT id FROM secrets)",
        "SELECT * FROM dataset WHERE EXISTS (FROM secrets)",
    ):
        with pytest.raises((g.SQLPolicyError, AnalysisException)):
            g.guarded_sql(spark, table, sql)
    named = "SELECT a.secrets FROM (SELECT id AS secrets FROM dataset) a, range(2), (VALUES (1)) v(x)"
    assert g.guarded_sql(spark, table, named, None).count() == 2000
    spark.catalog.dropTempView("secrets")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_bad_sql_fails_before_running(spark, table):
    with pytest.raises(AnalysisException):
        g.guarded_sql(spark, table, "SELECT nope FROM dataset")


def test_timeout(spark, table):
    slow = "SELECT SUM(x) AS s FROM (SELECT explode(sequence(1, 2000000)) AS x FROM dataset) WHERE sin(x) > 2"
    with pytest.raises(g.SQLTimeoutError):
        g.collect_guarded(spark, table, slow, timeout_seconds=1.0)


def test_critic(spark):
    rows = [
        ("ok", [], ["SELECT 1"], 1, []),
        ("bad", ["x", "y"], ["SELECT 1", "DROP TABLE t"], 0, ["boom"]),
    ]
    checks = spark.createDataFrame(
        rows,
        "analysis_id string, missing_columns array<string>, sqls array<string>, result_count int, errors array<string>",
    )
    found = {r["analysis_id"]: r for r in g.critic_verdict(checks).collect()}
    assert found["ok"]["status"] == "passed" and found["ok"]["issues"] == []
    assert [i["type"] for i in found["bad"]["issues"]] == [
        "missing_column", "empty_execution", "unsafe_sql", "execution_error",
    ]
    assert not found["bad"]["queries_read_only"]
