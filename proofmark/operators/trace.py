"""Trace tables of analyses: numbering, latest state, assembly, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.columns import col
from proofmark.operators.ordering import place_in_order

PRIVATE_FIELD = "storage_uri"


def step_sequence(steps: DataFrame, first_taken: DataFrame | None = None) -> DataFrame:
    """Number steps 1, 2, ... within each analysis by (created_at, id).

    ``first_taken`` (analysis_id, last_sequence) continues after numbers already given.
    One analysis may own a large share of all steps: numbering is by range slices.
    """
    numbered = place_in_order(steps, ["analysis_id"], ["created_at", "id"]).withColumn(
        "sequence", F.col("before") + 1
    ).drop("before")
    if first_taken is None:
        return numbered
    return (
        numbered.join(first_taken.select("analysis_id", "last_sequence"), "analysis_id", "left")
        .withColumn("sequence", F.col("sequence") + F.coalesce("last_sequence", F.lit(0)))
        .drop("last_sequence")
    )


def latest_state(history: DataFrame, key: str = "analysis_id", updated: str = "updated_at") -> DataFrame:
    """Last written state per analysis from an append-only history, as a partial aggregate."""
    values = [c for c in history.columns if c not in (key, updated)]
    state = F.struct(F.col(updated), *[F.col(c) for c in values])
    return history.groupBy(key).agg(F.max(state).alias("s")).select(key, "s.*")


def assemble_trace(
    analyses: DataFrame, steps: DataFrame, artifacts: DataFrame, evaluations: DataFrame
) -> DataFrame:
    """Long form of the full trace: one row per step, artifact or evaluation with its
    analysis: (analysis_id, status, part, position, id, payload).

    The nested document per analysis is never built here, because one analysis may own a
    large share of all rows; ``nested_trace`` builds it for a bounded selection.  Inputs:
    analyses(analysis_id, status); steps(analysis_id, sequence, id, payload);
    artifacts and evaluations (analysis_id, created_at, id, payload).
    """
    def numbered(rows: DataFrame) -> DataFrame:
        return place_in_order(rows, ["analysis_id"], ["created_at", "id"]).withColumn(
            "position", F.col("before") + 1
        )

    def part(rows: DataFrame, name: str, position: str) -> DataFrame:
        return rows.select(
            "analysis_id",
            F.lit(name).alias("part"),
            F.col(position).cast("long").alias("position"),
            F.col("id").cast("string").alias("id"),
            F.col("payload").cast("string").alias("payload"),
        )

    parts = (
        part(steps, "step", "sequence")
        .unionByName(part(numbered(artifacts), "artifact", "position"))
        .unionByName(part(numbered(evaluations), "evaluation", "position"))
    )
    heads = analyses.select("analysis_id", "status")
    # Inner and anti join instead of a left join: adaptive execution can then split the
    # parts of an analysis that owns very many of them.
    bare = heads.join(parts.select("analysis_id").distinct(), "analysis_id", "left_anti")
    return heads.join(parts, "analysis_id").unionByName(bare, allowMissingColumns=True)


def nested_trace(trace: DataFrame, analysis_ids: list) -> DataFrame:
    """Documents with ordered parts for the named analyses (what one trace page shows)."""
    wanted = trace.where(F.col("analysis_id").isin(*analysis_ids))

    def ordered(name: str) -> Column:
        found = F.collect_list(
            F.when(F.col("part") == name, F.struct("position", "id", "payload"))
        )
        return F.sort_array(found).alias(f"{name}s")

    return wanted.groupBy("analysis_id", "status").agg(
        ordered("step"), ordered("artifact"), ordered("evaluation")
    )


def _public(value: Column, kind: T.DataType) -> Column:
    """``value`` without the private field at any depth."""
    if isinstance(kind, T.StructType):
        kept = [
            _public(value.getField(f.name), f.dataType).alias(f.name)
            for f in kind.fields
            if f.name != PRIVATE_FIELD
        ]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _public(item, kind.elementType))
    if isinstance(kind, T.MapType):
        public = F.map_filter(value, lambda key, _: key != PRIVATE_FIELD)
        return F.transform_values(public, lambda _, item: _public(item, kind.valueType))
    return value


def redact_fields(df: DataFrame) -> DataFrame:
    return df.select(
        *[_public(col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name != PRIVATE_FIELD]
    )


def decode_json_columns(df: DataFrame, schemas: dict[str, T.DataType | str]) -> DataFrame:
    """Replace each ``x_json`` text column by the parsed column ``x``; malformed text is NULL."""
    columns = []
    for name in df.columns:
        if name in schemas:
            columns.append(F.from_json(col(name), schemas[name]).alias(name.removesuffix("_json")))
        else:
            columns.append(col(name))
    return df.select(*columns)
