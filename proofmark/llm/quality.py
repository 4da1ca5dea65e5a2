"""Operator 10: quality classifier, a factorisation machine over whole texts.

Features: hashed words (square roots of their shares), structure statistics of the text, and
the size class of the document as metadata.  The score is
``w0 + w.x + 1/2 * sum_f((V_f.x)^2 - V_f^2.x^2)`` through a logistic link; the identity makes
the pairwise part linear in the features.

The model is fitted on at most ``SAMPLE`` labelled rows, those least by a hash of their id,
so the fit costs the same at every size; scoring covers every row and whole texts.

Cases: a null text counts as empty and gets a score like any other; labels that are null or
whose document is missing are not used, repeated labels count as often as they occur;
without labels of both kinds every score is the share of label 1 (0.5 without labels);
a null id counts as held out; an empty table gives an empty result.  Columns of the input
that carry the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.registry.base import table

BUCKETS = 2048
FACTORS = 8
SAMPLE = 8_192
THRESHOLD = 0.3
EPOCHS = 30
BATCH = 256
RATE = 0.01
SHRINK = 1e-4
SEED = 3
# Words remembered by one worker, rows scored at once.
_WORDS = 100_000
_ROWS = 256

_MARKS = b".,;:!?|#*%&$@<>{}[]()/\\=+_-~^\"'`"
_STATS = 14 + len(_MARKS)
# Size classes: powers of two of the characters, as one-hot metadata.
_SIZES = 24


class Features:
    """Feature rows of texts: word buckets, then statistics, then the size class."""

    width = BUCKETS + _STATS + _SIZES

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def _buckets(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        try:
            codes = [known[w] for w in words]
        except KeyError:
            if len(known) >= _WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS
            codes = [known[w] for w in words]
        return np.bincount(np.array(codes, np.int64), minlength=BUCKETS)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = np.zeros((len(texts), self.width), np.float32)
        for i, text in enumerate(texts):
            self._fill(found[i], text or "")
        return found

    def _fill(self, row: np.ndarray, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        row[BUCKETS + _STATS + min(_SIZES - 1, len(text).bit_length())] = 1
        if not data:
            return
        words = data.split()
        count = len(words)
        if count:
            row[:BUCKETS] = np.sqrt(self._buckets(words) / count)
        octets = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        size = len(data)
        lines = [x for x in data.split(b"\n") if x.strip()]
        distinct = len(set(words))
        stats = [
            np.log1p(size) / 10,
            octets[65:91].sum() / size,
            octets[97:123].sum() / size,
            octets[48:58].sum() / size,
            octets[32] / size,
            octets[10] / size * 10,
            octets[128:].sum() / size,
            size / max(1, count) / 10,
            distinct / max(1, count),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(len(lines)) / 5,
            count / max(1, len(lines)) / 50,
            np.log1p(count / max(1, distinct)),
            octets[65:91].sum() / max(1, octets[65:91].sum() + octets[97:123].sum()),
        ]
        stats += [octets[m] / max(1, count) for m in _MARKS]
        row[BUCKETS : BUCKETS + _STATS] = np.minimum(stats, 4)


def raw_scores(x: np.ndarray, model: tuple) -> np.ndarray:
    """Log-odds; linear in the features by the sum-of-squares identity."""
    bias, linear, factors = model
    return bias + x @ linear + 0.5 * ((x @ factors) ** 2 - (x**2) @ (factors**2)).sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> tuple:
    """(bias, linear, factors) by Adam steps on the logistic loss."""
    width = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    random = np.random.default_rng(SEED)
    zero = (np.float32(0), np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32))
    if not len(y) or not 0 < share < 1:
        edge = np.clip(share, 1e-3, 1 - 1e-3)
        return (np.float32(np.log(edge / (1 - edge))), *zero[1:])
    model = [
        np.float32(np.log(share / (1 - share))),
        zero[1].copy(),
        random.normal(0, 0.05, (width, FACTORS)).astype(np.float32),
    ]
    first, second = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for start in range(0, len(y), BATCH):
            at = order[start : start + BATCH]
            part = x[at]
            inner = part @ model[2]
            odds = raw_scores(part, model)
            slope = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[at]) / len(at)).astype(
                np.float32
            )
            gradients = [
                slope.sum(),
                part.T @ slope + SHRINK * model[1],
                part.T @ (slope[:, None] * inner)
                - ((part**2).T @ slope)[:, None] * model[2]
                + SHRINK * model[2],
            ]
            step += 1
            for i, g in enumerate(gradients):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model[i] = (model[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(
                    np.float32
                )
    return tuple(model)


def held_out(key: str) -> Column:
    """Rows never used for fitting: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    documents: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    sample: int = SAMPLE,
) -> tuple:
    """Model from at most ``sample`` labelled rows that are not held out."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
        .select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key", "_label")
        .limit(sample)
    )

    def rows(batches):
        features = Features()
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1)
            for start in range(0, len(texts), _ROWS):
                x = features(texts[start : start + _ROWS])
                at, of = np.nonzero(x)
                ends = np.searchsorted(at, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        marks.slice(start, len(x)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(of.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(x[at, of])),
                    ],
                    ["label", "places", "amounts"],
                )

    # At most ``sample`` rows of two numbers: small at every size.  Where rows repeat an id,
    # the text with the least hash counts, and the least label.
    chosen = chosen.groupBy("_key").agg(F.min("_label").alias("_label"))
    joined = (
        documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
        .join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
        .groupBy("_id", "_label")
        .agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    )
    found = (
        joined.select("_text", "_label")
        .mapInArrow(rows, "label int, places array<int>, amounts array<float>")
        .toArrow()
    )
    x = np.zeros((found.num_rows, Features.width), np.float32)
    y = found.column("label").to_numpy().astype(np.float32)
    places, amounts = found.column("places"), found.column("amounts")
    for i in range(found.num_rows):
        x[i, places[i].values.to_numpy()] = amounts[i].values.to_numpy()
    # One order at every partitioning, so that the fit is repeatable.
    order = np.argsort([xxhash.xxh3_64_intdigest(r.tobytes()) for r in x], kind="stable")
    return fit(x[order], y[order])


def score(text: str, model: tuple):
    """Column of scores from 0 to 1."""

    @F.arrow_udf("double")
    def scored(batch: pa.Array) -> pa.Array:
        features = Features()
        found = []
        for start in range(0, len(batch), _ROWS):
            odds = raw_scores(features(batch.slice(start, _ROWS).to_pylist()), model)
            found.append(1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -30, 30))))
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return scored(F.col(text).cast("string"))


def judge_quality(
    documents: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents with held_out, score and predicted."""
    model = train(documents, labels, text, key, label)
    return documents.withColumn("score", score(text, model)).withColumns(
        {
            "held_out": held_out(key),
            "predicted": F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)),
        }
    )


def op10_quality_machine(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text")
    labels = table(spark, directory, "labels")
    return judge_quality(documents, labels).select("doc_id", "held_out", "score", "predicted")
