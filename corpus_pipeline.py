"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage is (name, function(spark, docs, sf_dir) -> DataFrame) and gets what the stage
before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.llm.mixture import mix
from proofmark.llm.neardup import keep_one
from proofmark.llm.packing import pack_documents
from proofmark.llm.passages import cut_passages
from proofmark.llm.quality import THRESHOLD, score, train
from proofmark.registry.base import table
from proofmark.workspace import pin


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns as they were."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(score("text", model) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    return keep_one(docs).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier document."""
    return cut_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document not taken has no row.

    The columns are renamed meanwhile, so that none clashes with those of the mix.
    """
    own = {c: f"_in_{c}" for c in docs.columns}
    names = {k: own[v] for k, v in (("text", "text"), ("source", "source"), ("key", "doc_id"))}
    taken = mix(docs.withColumnsRenamed(own), **names).where(F.col("repeats") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_pass")
    return taken.select(*[F.col(i).alias(c) for c, i in own.items()], again).drop("_pass")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", passages),
    ("source mixture", mixture),
    ("best-fit packing", packing),
]

# The classifier, MinHash, chaining and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = pin(docs, name.replace(" ", "-"))
    return docs
