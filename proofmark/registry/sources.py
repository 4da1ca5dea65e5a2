"""Sources and sinks."""

from pyspark.sql import functions as F

from proofmark.operators.aggregates import grouped_aggregate
from proofmark.registry.base import fixed, query, table, union_sql
from proofmark.sources import ingest, readers, sinks
from proofmark.workspace import scratch_path


@query(
    "scan_csv",
    "SELECT doc_id, '\"' || lang || '\", she said' || chr(10) || text AS text, source FROM documents",
)
def scan_csv(spark, d):
    """Texts with quotes, commas and line breaks, in RFC 4180 form (doubled quotes)."""
    path = scratch_path(spark, "csv")
    said = F.concat(F.lit('"'), "lang", F.lit('", she said\n'), "text")
    rows = table(spark, d, "documents").select("doc_id", said.alias("text"), "source")
    rfc = {"header": True, "quoteAll": True, "quote": '"', "escape": '"'}
    rows.write.options(**rfc).csv(path)
    return readers.scan_csv(spark, path, "doc_id long, text string, source string")


@query(
    "scan_parquet",
    "SELECT l_returnflag, COUNT(*) AS row_count, ROUND(SUM(l_quantity), 2) AS quantity "
    "FROM lineitem GROUP BY 1",
)
def scan_parquet(spark, d):
    lines = readers.scan_parquet(spark, f"{d}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("row_count"), fixed(F.sum("l_quantity"), 2).alias("quantity")
    )


_TEXT_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _text_orders(spark, d):
    """Orders as all-text rows, with an empty price where the status is P."""
    orders = table(spark, d, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_totalprice").cast("string"))
    return orders.select(
        *[(price if c == "o_totalprice" else F.col(c).cast("string")).alias(c) for c in _TEXT_COLUMNS]
    )


def _infer_sql():
    texts = ", ".join(
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice"
        if c == "o_totalprice"
        else f"CAST({c} AS VARCHAR) AS {c}"
        for c in _TEXT_COLUMNS
    )
    parts = [
        f"SELECT {i} AS position, '{c}' AS \"column\", CASE "
        f"WHEN bool_and(regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?')) THEN 'DATE' "
        f"WHEN bool_and(TRY_CAST({c} AS BIGINT) IS NOT NULL AND regexp_full_match({c}, '[+-]?\\d+')) THEN 'BIGINT' "
        f"WHEN bool_and(TRY_CAST({c} AS DOUBLE) IS NOT NULL OR {c} IS NULL) THEN 'DOUBLE' "
        f"ELSE 'VARCHAR' END AS \"type\" FROM t"
        for i, c in enumerate(_TEXT_COLUMNS)
    ]
    return f"WITH t AS (SELECT {texts} FROM orders) " + union_sql(parts)


@query("infer_types", _infer_sql())
def infer_types(spark, d):
    return readers.infer_types(_text_orders(spark, d))


@query(
    "coerce_types",
    "SELECT o_orderkey, o_custkey, o_orderstatus, "
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, o_orderpriority FROM orders",
)
def coerce_types(spark, d):
    texts = _text_orders(spark, d)
    types = {r["column"]: r["type"] for r in readers.infer_types(texts).collect()}
    return readers.coerce_types(texts, types)


@query("admit_files")
def admit_files(spark, d):
    """The verdict on each file of the documents, with the rows it would bring."""
    path = f"{d}/documents.parquet"
    rows = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_name").alias("name"))
        .agg(F.count("doc_id").alias("documents"), F.sum("n_chars").alias("characters"))
    )
    return ingest.admit_files(ingest.list_files(spark, path)).join(rows, "name", "left")


@query("fingerprint_files")
def fingerprint_files(spark, d):
    return ingest.fingerprint_files(spark, d)


@query("fingerprint_table")
def fingerprint_table(spark, d):
    return ingest.fingerprint_table(table(spark, d, "lineitem"))


@query(
    "dedupe_ingest",
    "WITH files AS (SELECT source || '-' || doc_id || '.csv' AS name, "
    "'sha256:' || sha256(text) AS fingerprint, n_chars AS size_bytes FROM documents), "
    "known AS (SELECT 'sha256:' || sha256(d.text) AS fingerprint, MIN('ds_' || d.doc_id) AS existing_id "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1), "
    "batch AS (SELECT fingerprint, MIN(name) AS name, MIN(size_bytes) AS size_bytes, "
    "COUNT(*) AS file_count FROM files GROUP BY 1) "
    "SELECT b.fingerprint, b.name, b.size_bytes, b.file_count, k.existing_id, "
    "k.existing_id IS NULL AS is_new FROM batch b LEFT JOIN known k ON b.fingerprint = k.fingerprint",
)
def dedupe_ingest(spark, d):
    """Documents as files; the labelled ones are in the catalog already."""
    documents = table(spark, d, "documents")
    fingerprint = F.concat(F.lit("sha256:"), F.sha2("text", 256))
    files = documents.select(
        F.concat("source", F.lit("-"), "doc_id", F.lit(".csv")).alias("name"),
        fingerprint.alias("fingerprint"),
        F.col("n_chars").alias("size_bytes"),
    )
    known = documents.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.concat(F.lit("ds_"), "doc_id").alias("id"), fingerprint.alias("fingerprint")
    )
    return ingest.dedupe_ingest(files, known)


@query(
    "dataset_catalog",
    "SELECT 'ds_' || user_id AS id, 'user-' || user_id || '.csv' AS name, "
    "CAST(SUM(length(props)) AS BIGINT) AS size_bytes, MAX(ts) AS created_at "
    "FROM events GROUP BY user_id",
)
def dataset_catalog(spark, d):
    rows = (
        table(spark, d, "events")
        .groupBy("user_id")
        .agg(F.sum(F.length("props")).alias("size_bytes"), F.max("ts").alias("created_at"))
        .select(
            F.concat(F.lit("ds_"), "user_id").alias("id"),
            F.concat(F.lit("user-"), "user_id", F.lit(".csv")).alias("name"),
            F.concat(F.lit("sha256:"), F.sha2(F.col("user_id").cast("string"), 256)).alias("fingerprint"),
            F.lit(None).alias("schema_json"),
            F.lit(None).alias("profile_json"),
            F.lit(None).alias("storage_uri"),
            "size_bytes",
            "created_at",
        )
    )
    path = scratch_path(spark, "catalog")
    ingest.register(rows, path)
    return ingest.newest_first(ingest.catalog(spark, path)).select("id", "name", "size_bytes", "created_at")


@query(
    "bounded_result",
    "WITH t AS (SELECT o_orderkey, o_totalprice FROM orders "
    "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 500) "
    "SELECT o_orderkey, o_totalprice, COUNT(*) OVER () AS row_count, "
    "COUNT(*) OVER () >= 500 AS truncated FROM t",
)
def bounded_result(spark, d):
    """The 500-row cap is the operator itself: the largest orders."""
    ranked = table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc_nulls_last("o_totalprice"), "o_orderkey"
    )
    return sinks.bounded_result(ranked)


@query(
    "json_safe_rows",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
    "CASE WHEN extract('microseconds' FROM ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts, "
    "lower(hex(event_type)) AS event_type, CAST(value AS DOUBLE) AS value FROM events",
)
def json_safe_rows(spark, d):
    events = table(spark, d, "events").select(
        "event_id",
        "ts",
        F.col("event_type").cast("binary").alias("event_type"),
        F.col("value").cast("decimal(18,2)").alias("value"),
    )
    return sinks.json_safe_rows(events)


_ENVELOPE_SQL = "SELECT o_orderpriority AS segment, COUNT(*) AS row_count FROM dataset GROUP BY 1"


@query(
    "evidence_envelope",
    "WITH t AS (SELECT o_orderpriority AS segment, COUNT(*) AS row_count FROM orders GROUP BY 1) "
    "SELECT 'evidence_grouped_aggregate' AS id, 'grouped_aggregate' AS \"key\", 'Orders per priority' AS purpose, "
    f"'{_ENVELOPE_SQL}' AS \"sql\", 'segment,row_count' AS \"columns\", "
    "string_agg('{\"segment\":\"' || segment || '\",\"row_count\":' || row_count || '}', chr(10) "
    "ORDER BY row_count DESC, segment) AS \"rows\", CAST(COUNT(*) AS INTEGER) AS row_count, "
    "COUNT(*) >= 500 AS truncated, 'spark' AS source FROM t",
)
def evidence_envelope(spark, d):
    counts = (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("segment"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    order = [F.desc("row_count"), F.asc("segment")]
    record = sinks.evidence_envelope(counts, "grouped_aggregate", "Orders per priority", _ENVELOPE_SQL, order)
    return record.withColumns(
        {"columns": F.array_join("columns", ","), "rows": F.array_join("rows", "\n")}
    )


@query(
    "append_trace",
    "SELECT CAST(ts AS DATE) AS event_date, event_type AS status, COUNT(*) AS step_count, "
    "MIN(event_id) AS first_id FROM events GROUP BY 1, 2",
)
def append_trace(spark, d):
    """Failed and other steps appended separately, then read back as one table."""
    steps = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("analysis_id"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("created_at"),
    )
    path = scratch_path(spark, "steps")
    failed = F.col("status") == "error"
    sinks.append_trace(steps.where(failed), path)
    sinks.append_trace(steps.where(~failed), path)
    return (
        sinks.read_trace(spark, path)
        .groupBy("event_date", "status")
        .agg(F.count(F.lit(1)).alias("step_count"), F.min("id").alias("first_id"))
    )


@query(
    "write_chart_spec",
    "SELECT c_mktsegment AS x, ROUND(SUM(c_acctbal), 2) AS y FROM customer GROUP BY 1",
)
def write_chart_spec(spark, d):
    points = grouped_aggregate(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    path = scratch_path(spark, "chart")
    sinks.write_chart_spec(points.select(F.col("segment").alias("x"), F.col("metric_value").alias("y")), path)
    return sinks.read_report(spark, path, "x string, y double").select("x", fixed("y", 2).alias("y"))


@query(
    "write_benchmark_report",
    "SELECT event_type AS category, COUNT(*) AS total, ROUND(AVG(value), 6) AS score FROM events GROUP BY 1",
)
def write_benchmark_report(spark, d):
    report = table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(
        F.count(F.lit(1)).alias("total"), F.avg("value").alias("score")
    )
    path = scratch_path(spark, "report")
    sinks.write_report(report, path)
    latest = sinks.read_report(spark, path, "category string, total long, score double")
    return latest.withColumn("score", fixed("score"))
