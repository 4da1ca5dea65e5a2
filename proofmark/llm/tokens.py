"""Operator 9: token counts of whole texts.

Arrow batches go to Python and only lengths come back.  A batch is worked through in
portions of about equal bytes; a long text is cut at boundaries where no token can
cross (``vocabulary``), so neither memory nor results depend on its length.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and repeated ids are
counted row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.llm.vocabulary import counter_kind, loaded
from proofmark.registry.base import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
# Characters handed to the encoder at once.
PORTION = 4_000_000


def portions(lengths: list[int], most: int):
    """Index ranges of neighbouring texts holding about ``most`` characters each."""
    start, held = 0, 0
    for i, length in enumerate(lengths):
        if i > start and held + length > most:
            yield start, i
            start, held = i, 0
        held += length
    if start < len(lengths):
        yield start, len(lengths)


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Column of token counts by the vocabulary file at ``path``; null counts as empty."""
    path = path or public_tokenizers.path(TOKENIZER)
    kind = counter_kind(path)

    @F.arrow_udf("long")
    def count(batch: pa.Array) -> pa.Array:
        encoder = loaded(kind, path)
        lengths = [n or 0 for n in pa.compute.binary_length(batch).to_pylist()]
        counts = []
        for start, end in portions(lengths, PORTION):
            texts = batch.slice(start, end - start).to_pylist()
            counts += [encoder(t) if t else 0 for t in texts]
        return pa.array(counts, pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)


def count_tokens(
    documents: DataFrame,
    text: str = "text",
    path: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """The rows with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Columns of the input that carry one of these names are replaced.
    """
    return documents.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": token_count(text, path),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text")
    return count_tokens(documents).select("doc_id", "n_bytes", "n_tokens", "over_limit")
