"""Evaluation, trace and report jobs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofmark.operators import aggregates, evaluate, report, trace
from proofmark.operators.sql_guard import guarded_sql
from proofmark.operators.user_code import grouped_apply
from proofmark.plans.wording import ANSWER
from proofmark.registry.base import fixed, query, table


@query(
    "numerical_score",
    "SELECT event_id, CASE WHEN ABS(value - e) <= GREATEST(0.001 * GREATEST(ABS(value), ABS(e)), 0.001) "
    "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT event_id, value, ROUND(value, 1) AS e FROM events)",
)
def numerical_score(spark, d):
    expected = F.round("value", 1)
    return table(spark, d, "events").select(
        "event_id", evaluate.numerical_score(F.col("value"), expected, F.lit(0.001)).alias("score")
    )


@query(
    "expectation_score",
    "SELECT event_id, CASE event_type "
    "WHEN 'click' THEN CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    "WHEN 'view' THEN CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    "WHEN 'error' THEN CASE WHEN props IN ('{\"k\": 1}', '{\"k\": 2}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    "WHEN 'signup' THEN CASE WHEN ABS(value - ROUND(value, 0)) <= GREATEST(0.01 * GREATEST(ABS(value), ABS(ROUND(value, 0))), 0.01) "
    "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
    "ELSE CASE WHEN props = '{\"k\": 3}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM events",
)
def expectation_score(spark, d):
    """The event type picks the matcher."""
    def only(kind, value):
        return F.when(F.col("event_type") == kind, value)

    score = evaluate.expectation_score(
        F.col("value"),
        F.col("props"),
        only("error", F.array(F.lit('{"k": 1}'), F.lit('{"k": 2}'))),
        only("click", F.lit(50.0)),
        only("view", F.lit(50.0)),
        only("signup", F.round("value", 0)),
        F.lit('{"k": 3}'),
        F.lit(0.01),
    )
    return table(spark, d, "events").select("event_id", score.alias("score"))


@query(
    "evidence_coverage",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN 0.0::DOUBLE ELSE (CASE WHEN contains(t, 'evidence:aggregate') THEN 1 ELSE 0 END "
    "+ CASE WHEN contains(t, 'evidence:' || source) THEN 1 ELSE 0 END) / 2.0::DOUBLE END AS coverage "
    "FROM (SELECT doc_id, lang, source, text || CASE WHEN n_chars > 500 THEN ' [evidence:aggregate]' ELSE '' END "
    "|| ' [evidence:' || source || ']' AS t FROM documents)",
)
def evidence_coverage(spark, d):
    """Document texts as reports; long ones cite both keys, German ones have no keys."""
    documents = table(spark, d, "documents")
    text = F.concat(
        "text",
        F.when(F.col("n_chars") > 500, " [evidence:aggregate]").otherwise(""),
        F.lit(" [evidence:"),
        "source",
        F.lit("]"),
    )
    keys = F.when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(
        F.array(F.lit("aggregate"), F.col("source"))
    )
    return documents.select("doc_id", evaluate.evidence_coverage(text, keys).alias("coverage"))


@query(
    "select_evidence_cell",
    "WITH r AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, "
    "o_orderpriority) AS p FROM orders GROUP BY 1, 2), c AS (SELECT DISTINCT o_custkey FROM orders) "
    "SELECT c.o_custkey AS analysis_id, CASE WHEN c.o_custkey % 2 = 0 THEN r.o_orderpriority ELSE CAST(r.n AS VARCHAR) END AS actual "
    "FROM c LEFT JOIN r ON c.o_custkey = r.o_custkey AND r.p = c.o_custkey % 3 + 1",
)
def select_evidence_cell(spark, d):
    """One evidence per customer; which row and field is wanted depends on the customer."""
    evidence = _customer_evidence(spark, d)
    field = F.when(F.col("analysis_id") % 2 == 0, "segment").otherwise("metric_value")
    index = (F.col("analysis_id") % 3).cast("int")
    return evidence.select("analysis_id", evaluate.select_evidence_cell(F.col("rows"), index, field).alias("actual"))


def _customer_rows(spark, d):
    """(analysis_id, segment, metric_value, row_index): orders per priority and customer.

    A customer has at most one row per priority, so the numbering window is tiny.
    """
    counts = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("analysis_id"), F.col("o_orderpriority").alias("segment"))
        .agg(F.count(F.lit(1)).alias("metric_value"))
    )
    order = Window.partitionBy("analysis_id").orderBy(F.desc("metric_value"), "segment")
    return counts.withColumn("row_index", F.row_number().over(order) - 1)


def _customer_evidence(spark, d):
    rows = _customer_rows(spark, d)
    packed = rows.groupBy("analysis_id").agg(
        F.sort_array(
            F.collect_list(F.struct("row_index", F.to_json(F.struct("segment", "metric_value")).alias("json")))
        ).alias("_rows")
    )
    return packed.select("analysis_id", F.transform("_rows", lambda r: r["json"]).alias("rows"))


@query(
    "rows_equal",
    "WITH a AS (SELECT text, lang FROM documents), b AS (SELECT text, lang FROM documents WHERE n_chars > 100), "
    "l AS (SELECT COUNT(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), "
    "r AS (SELECT COUNT(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) "
    "SELECT 'long only' AS comparison, l.n AS only_left, r.n AS only_right, l.n + r.n = 0 AS equal FROM l, r "
    "UNION ALL SELECT 'itself', 0, 0, true",
)
def rows_equal(spark, d):
    texts = table(spark, d, "documents")
    pair = texts.select("text", "lang")
    shorter = evaluate.rows_equal(pair, texts.where(F.col("n_chars") > 100).select("text", "lang"))
    itself = evaluate.rows_equal(pair, pair)
    return shorter.withColumn("comparison", F.lit("long only")).unionByName(
        itself.withColumn("comparison", F.lit("itself"))
    )


_SUPPLIED = (
    "SELECT l_suppkey AS segment, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS metric_value, COUNT(*) AS row_count "
    "FROM {source} GROUP BY 1"
)


@query(
    "reproducibility",
    f"WITH a AS ({_SUPPLIED.format(source='lineitem')}), b AS ({_SUPPLIED.format(source='lineitem')}), "
    "l AS (SELECT COUNT(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), "
    "r AS (SELECT COUNT(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) "
    "SELECT l.n AS only_left, r.n AS only_right, l.n + r.n = 0 AS equal FROM l, r",
)
def reproducibility(spark, d):
    """The DataFrame result and the re-run of its recorded SQL hold the same rows; decimal
    sums do not depend on the order of the rows."""
    lines = table(spark, d, "lineitem")
    quantity = F.col("l_quantity").cast("decimal(18,2)")
    recorded = aggregates.grouped_aggregate(
        lines.select("l_suppkey", quantity.alias("l_quantity")), "l_suppkey", "l_quantity"
    )
    again = guarded_sql(spark, lines, _SUPPLIED.format(source="dataset"), cap=None)
    return evaluate.rows_equal(recorded, again)


@query(
    "evaluate_records",
    "WITH r AS (SELECT o_custkey, o_orderpriority AS s, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY o_custkey "
    "ORDER BY COUNT(*) DESC, o_orderpriority) AS p FROM orders GROUP BY 1, 2), "
    "q AS (SELECT c.c_mktsegment AS category, c.c_custkey % 2 AS kind, r.s, r.n FROM customer c "
    "LEFT JOIN r ON c.c_custkey = r.o_custkey AND r.p = 1), "
    "e AS (SELECT category, CASE WHEN s IS NULL THEN 0.0 WHEN kind = 0 THEN CAST(s = '1-URGENT' AS DOUBLE) "
    "ELSE CAST(n > 3 AS DOUBLE) END AS score FROM q) "
    "SELECT category, COUNT(*) AS total, COUNT(*) FILTER (WHERE score = 1) AS passed, ROUND(AVG(score), 6) AS score "
    "FROM e GROUP BY 1",
)
def evaluate_records(spark, d):
    """One record per customer: the leading priority of its orders, or how often it occurs."""
    even = F.col("c_custkey") % 2 == 0
    records = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("category"),
        F.lit("grouped_aggregate").alias("evidence_key"),
        F.lit(0).alias("row"),
        F.when(even, "segment").otherwise("metric_value").alias("field"),
        F.lit(None).cast("array<string>").alias("one_of"),
        F.lit(None).cast("double").alias("lt"),
        F.when(~even, F.lit(3.0)).alias("gt"),
        F.lit(None).cast("double").alias("value"),
        F.when(even, F.lit("1-URGENT")).alias("value_text"),
        F.lit(None).cast("double").alias("tolerance"),
    )
    answers = _customer_evidence(spark, d).select(
        F.col("analysis_id").alias("id"),
        F.lit(True).alias("execution_success"),
        F.array(F.struct(F.lit("grouped_aggregate").alias("key"), "rows")).alias("evidence"),
        F.lit("[evidence:grouped_aggregate]").alias("answer"),
        F.array(F.lit("SELECT 1")).alias("sqls"),
        F.lit(True).alias("reproducible"),
        F.lit(1.0).alias("latency_ms"),
    )
    found = evaluate.benchmark_by_category(evaluate.evaluate_records(records, answers))
    return found.withColumn("score", fixed("score"))


@query(
    "duplicate_record_ids",
    "SELECT id, COUNT(*) AS n, CASE WHEN id = '' THEN 'missing' ELSE 'duplicate' END AS problem FROM "
    "(SELECT COALESCE(CASE WHEN n_chars < 50 THEN NULL ELSE sha256(text) END, '') AS id FROM documents) "
    "GROUP BY 1 HAVING COUNT(*) > 1 OR id = ''",
)
def duplicate_record_ids(spark, d):
    """Text digests as record ids; very short documents have none."""
    records = table(spark, d, "documents").select(
        F.when(F.col("n_chars") >= 50, F.sha2("text", 256)).alias("id")
    )
    return evaluate.faulty_record_ids(records)


def _results(spark, d):
    """Events as benchmark results."""
    kind, number = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    results = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        kind.alias("category"),
        (kind != "error").alias("execution_success"),
        F.when(number % 10 == 0, 0.0).otherwise(1.0).alias("score"),
        (kind != "signup").alias("numeric_case"),
        F.when(kind != "view", F.when(F.col("value") > 20, 1.0).otherwise(0.5)).alias("evidence_coverage"),
        F.when(kind != "view", F.col("value") > 1).alias("read_only_sql_valid"),
        F.when(kind != "view", F.col("value") < 200).alias("reproducible"),
        (F.col("value") * 10).cast("int").alias("latency_ms"),
    )
    return evaluate.record_status(results)


_RESULTS_SQL = (
    "(SELECT *, CASE WHEN execution_success AND score = 1 AND COALESCE(read_only_sql_valid, true) "
    "AND COALESCE(reproducible, true) THEN 'passed' ELSE 'failed' END AS status FROM "
    "(SELECT event_id AS id, event_type AS category, event_type <> 'error' AS execution_success, "
    "CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score, "
    "event_type <> 'signup' AS numeric_case, "
    "CASE WHEN event_type <> 'view' THEN CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS evidence_coverage, "
    "CASE WHEN event_type <> 'view' THEN value > 1 END AS read_only_sql_valid, "
    "CASE WHEN event_type <> 'view' THEN value < 200 END AS reproducible, "
    "CAST(trunc(value * 10) AS INTEGER) AS latency_ms FROM events))"
)


@query("record_status", f"SELECT id, status FROM {_RESULTS_SQL}")
def record_status(spark, d):
    return _results(spark, d).select("id", "status")


@query(
    "benchmark_summary",
    "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'passed') AS passed, "
    "COUNT(*) FILTER (WHERE status <> 'passed') AS failed, ROUND(AVG(score), 6) AS score, "
    "ROUND(AVG(CAST(execution_success AS INTEGER)), 6) AS execution_rate, "
    "COUNT(*) FILTER (WHERE numeric_case) AS numeric_total, ROUND(AVG(score) FILTER (WHERE numeric_case), 6) AS numeric_rate, "
    "COUNT(evidence_coverage) AS coverage_total, ROUND(AVG(evidence_coverage), 6) AS coverage_score, "
    "COUNT(read_only_sql_valid) AS policy_total, ROUND(AVG(CAST(read_only_sql_valid AS INTEGER)), 6) AS policy_rate, "
    "ROUND(AVG(CAST(reproducible AS INTEGER)), 6) AS reproducible_rate, "
    f"CAST(MEDIAN(latency_ms) AS DOUBLE) AS median_latency_ms FROM {_RESULTS_SQL}",
)
def benchmark_summary(spark, d):
    found = evaluate.benchmark_summary(_results(spark, d))
    rates = ("score", "execution_rate", "numeric_rate", "coverage_score", "policy_rate", "reproducible_rate")
    return found.select(
        "total", "passed", "failed", "numeric_total", "coverage_total", "policy_total", "median_latency_ms",
        *[fixed(r).alias(r) for r in rates],
    )


@query(
    "benchmark_by_category",
    "SELECT category, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'passed') AS passed, "
    f"ROUND(AVG(score), 6) AS score FROM {_RESULTS_SQL} GROUP BY 1",
)
def benchmark_by_category(spark, d):
    return evaluate.benchmark_by_category(_results(spark, d)).withColumn("score", fixed("score"))


# --- trace -------------------------------------------------------------------------------


@query(
    "step_sequence",
    "SELECT event_id AS id, user_id AS analysis_id, "
    "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events",
)
def step_sequence(spark, d):
    steps = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("analysis_id"), F.col("ts").alias("created_at")
    )
    return trace.step_sequence(steps).select("id", "analysis_id", "sequence")


@query(
    "latest_analysis_state",
    "SELECT user_id AS analysis_id, MAX(ts) AS updated_at, arg_max(event_type, ts) AS status, "
    "arg_max(event_id, ts) AS step_id FROM events GROUP BY 1",
)
def latest_analysis_state(spark, d):
    history = table(spark, d, "events").select(
        F.col("user_id").alias("analysis_id"),
        F.col("ts").alias("updated_at"),
        F.col("event_type").alias("status"),
        F.col("event_id").alias("step_id"),
    )
    return trace.latest_state(history)


_TRACE_SQL = (
    "WITH p AS (SELECT o_orderkey AS analysis_id, o_orderstatus AS status FROM orders), "
    "s AS (SELECT l_orderkey AS analysis_id, 'step' AS part, CAST(l_linenumber AS BIGINT) AS position, "
    "l_partkey || '-' || l_suppkey AS id, l_returnflag AS payload FROM lineitem UNION ALL "
    "SELECT event_id % 1000, 'artifact', ROW_NUMBER() OVER (PARTITION BY event_id % 1000 ORDER BY ts, event_id), "
    "CAST(event_id AS VARCHAR), event_type FROM events UNION ALL "
    "SELECT conv_id, 'evaluation', ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, text), CAST(turn AS VARCHAR), role "
    "FROM conversations) "
    "SELECT p.analysis_id, p.status, s.part, s.position, s.id, s.payload FROM p LEFT JOIN s ON p.analysis_id = s.analysis_id"
)


@query("assemble_trace", _TRACE_SQL)
def assemble_trace(spark, d):
    """Orders as analyses, line items as steps, events as artifacts, turns as evaluations."""
    analyses = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("status")
    )
    steps = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"),
        F.col("l_linenumber").alias("sequence"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_returnflag").alias("payload"),
    )
    artifacts = table(spark, d, "events").select(
        (F.col("event_id") % 1000).alias("analysis_id"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("payload"),
    )
    evaluations = table(spark, d, "conversations").select(
        F.col("conv_id").alias("analysis_id"),
        F.struct("turn", "text").alias("created_at"),
        F.col("turn").alias("id"),
        F.col("role").alias("payload"),
    )
    return trace.assemble_trace(analyses, steps, artifacts, evaluations)


@query(
    "redact_fields",
    "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"files\":[{\"name\":\"' || o_orderpriority || '\"}]}' AS detail "
    "FROM orders",
)
def redact_fields(spark, d):
    uri = F.concat(F.lit("/data/"), "o_orderkey").alias("storage_uri")
    nested = table(spark, d, "orders").select(
        "o_orderkey",
        uri,
        F.struct(
            F.col("o_orderstatus").alias("status"),
            uri,
            F.array(F.struct(F.col("o_orderpriority").alias("name"), uri)).alias("files"),
        ).alias("detail"),
    )
    return trace.redact_fields(nested).withColumn("detail", F.to_json("detail"))


@query(
    "decode_json_columns",
    "SELECT event_id, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER) AS k FROM events",
)
def decode_json_columns(spark, d):
    raw = table(spark, d, "events").select("event_id", F.col("props").alias("props_json"))
    return trace.decode_json_columns(raw, {"props_json": "k int"}).select("event_id", "props.k")


# --- report ------------------------------------------------------------------------------


@query(
    "chart_points",
    "WITH r AS (SELECT o_custkey AS analysis_id, o_orderpriority AS x, CAST(COUNT(*) AS DOUBLE) AS y, "
    "ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) - 1 AS position FROM orders GROUP BY 1, 2), "
    "k AS (SELECT analysis_id FROM r GROUP BY 1 HAVING COUNT(*) >= 2) "
    "SELECT r.analysis_id, 'grouped_aggregate' AS evidence_key, 'segment' AS x_name, 'metric_value' AS y_name, "
    "r.position, r.x, r.y, 'Bar chart metric_value berdasarkan segment; sumber grouped_aggregate.' AS alt_text "
    "FROM r JOIN k ON r.analysis_id = k.analysis_id WHERE r.position < 10",
)
def chart_points(spark, d):
    rows = _customer_rows(spark, d).select(
        "analysis_id",
        F.lit(0).alias("evidence_order"),
        F.lit("grouped_aggregate").alias("evidence_key"),
        "row_index",
        "segment",
        F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("month"),
        F.col("metric_value").cast("double").alias("metric_value"),
        F.lit(None).cast("double").alias("delta"),
        F.lit(None).cast("double").alias("missing_rate"),
    )
    return report.chart_points(rows)


def _ask(text):
    return ANSWER[text].replace("{question}", "Orders of customer ' || o_custkey || '?")


@query(
    "render_answer",
    "WITH r AS (SELECT o_custkey, o_orderpriority AS s, COUNT(*) AS n, ROW_NUMBER() OVER "
    "(PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) AS p FROM orders GROUP BY 1, 2), "
    "g AS (SELECT o_custkey, COUNT(*) AS segments, MAX(n) AS n, "
    "string_agg('- `' || s || '`: **' || n || '**', chr(10) ORDER BY p) FILTER (WHERE p <= 3) AS bullets FROM r GROUP BY 1) "
    f"SELECT o_custkey AS analysis_id, '{ANSWER['title']}' || chr(10) || CASE WHEN segments > 1 THEN '{_ask('grouped')}' "
    "|| chr(10) || bullets || chr(10) || chr(10) || "
    "'Evidence: `evidence_grouped_aggregate` [evidence:grouped_aggregate].' || chr(10) || "
    f"'Total segmen yang dikembalikan: **' || segments || '**.' || chr(10) || '{ANSWER['grouped_limit']}' "
    f"ELSE '{_ask('measured').replace('{value}', chr(39) + ' || n || ' + chr(39))}' || chr(10) || chr(10) || "
    "'Evidence: `evidence_grouped_aggregate` [evidence:grouped_aggregate].' || chr(10) || "
    f"'{ANSWER['aggregate_limit']}' END AS answer FROM g",
)
def render_answer(spark, d):
    """One grouped answer per customer."""
    analyses = _customer_evidence(spark, d).select(
        "analysis_id",
        F.concat(F.lit("Orders of customer "), "analysis_id", F.lit("?")).alias("question"),
        F.lit("aggregate").alias("answer_type"),
        F.array(
            F.struct(
                F.lit("evidence_grouped_aggregate").alias("id"), F.lit("grouped_aggregate").alias("key"), "rows"
            )
        ).alias("evidence"),
    )
    return report.render_answers(analyses).select("analysis_id", "answer")


@query(
    "grouped_apply",
    "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity * l_quantity), 2) AS squares FROM lineitem GROUP BY 1",
)
def grouped_apply_query(spark, d):
    """A user function that squares and adds per batch; Spark merges the partial sums."""

    def squares(batch):
        value = batch.assign(squares=batch["l_quantity"] ** 2)
        return value.groupby("l_returnflag", as_index=False).agg(
            n=("l_quantity", "size"), squares=("squares", "sum")
        )

    lines = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    merged = grouped_apply(
        lines,
        ["l_returnflag"],
        squares,
        "l_returnflag string, n long, squares double",
        [F.sum("n").alias("n"), F.sum("squares").alias("squares")],
    )
    return merged.withColumn("squares", fixed("squares", 2))
