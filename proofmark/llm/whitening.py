"""Operator 13: whitening of embeddings by incremental eigendecomposition.

1. Partial spectra: every input task keeps count, mean and eigendecomposition of the scatter of
   the rows it has seen, and moves it on by centred rank-one updates.  An update D + z z^T is
   solved as in the divide-and-conquer eigenvalue method: entries of z that hardly count and
   equal eigenvalues are deflated, the roots of the secular equation are found by rational
   interpolation inside their brackets, and z is recomputed from the roots, which keeps the
   eigenvectors orthogonal.  ``BLOCK`` rows at a time are first centred on their own mean and
   reduced to a triangle of the same scatter, whose rows are then the updates: at most one
   per dimension instead of one per row.
2. Partial spectra are combined in a tree, ``FAN`` at a time: the eigenpairs of one, and the
   difference of the means, are rank-one updates of the other.
3. Rayleigh-Ritz: all rows, centred on the exact mean, are projected on the combined basis;
   the small matrix of their second moments, added up over all tasks, is diagonalised and
   turns the basis into eigenvectors of double precision.

Nothing but the matrix of one spectrum reaches the driver.  A component is returned if its
eigenvalue is above ``NOTHING`` times the trace, since constant directions cannot be whitened.

Cases: vectors that are null, or hold a null or non-finite entry, take no part; shorter vectors
count as filled up with zeros; rows without id, repeated ids and repeated rows are rows of
their own, and are returned as such; equal vectors (or one) have no component, so the result
is empty, as for an empty table.  Components of equal eigenvalues are some orthogonal basis of
their space.  Signs are fixed by the largest entry of the component.  ``deviation`` fails
rather than overflows.  Vectors may have as many dimensions as a square matrix of them fits in
a task.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.registry.base import table
from proofmark.workspace import pin

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# Rows reduced at once, partial spectra combined in one task, numbers of a result batch.
BLOCK = 1_024
FAN = 16
PORTION = 200_000
# Share of the trace below which a direction counts as constant.
NOTHING = 1e-12

_PARTIAL = "part long, n long, mean array<double>, values array<double>, vectors array<double>"
_EPS = np.finfo(np.float64).eps


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(squares / (poles - x)) = 0, one above each pole: the nearest pole as an
    index and the distance from it.

    ``poles`` ascend and differ, ``squares`` are positive.  Distances from the nearest pole
    keep their digits where the roots themselves would lose them.
    """
    count = len(poles)
    index = np.arange(count)
    upper = np.append(poles[1:], poles[-1] + squares.sum())
    middle = (poles + upper) / 2
    at_middle = 1 + (squares / (poles[None, :] - middle[:, None])).sum(axis=1)
    near = np.where((at_middle >= 0) | (index == count - 1), index, np.minimum(index + 1, count - 1))
    low, high = poles - poles[near], upper - poles[near]
    halved = middle - poles[near]
    low, high = np.where(at_middle < 0, halved, low), np.where(at_middle >= 0, halved, high)
    x = (low + high) / 2
    gaps = poles[None, :] - poles[near][:, None]
    left = index[None, :] <= index[:, None]
    for _ in range(64):
        steps = gaps - x[:, None]
        terms = squares / steps
        slopes = terms / steps
        value = 1 + terms.sum(axis=1)
        low, high = np.where(value < 0, x, low), np.where(value >= 0, x, high)
        # The sums over the poles on either side are each replaced by one pole with the same
        # value and slope; the root of what results is the next guess.
        psi, phi = (slopes * left).sum(axis=1), (slopes * ~left).sum(axis=1)
        a = poles - poles[near] - x
        b = np.append(poles[1:], np.inf) - poles[near] - x
        with np.errstate(all="ignore"):
            c = value - a * psi - np.where(phi > 0, b * phi, 0)
            two = a * a * psi
            other = np.where(phi > 0, b * b * phi, 0)
            # c + two / (a - s) + other / (b - s) = 0 for the step s.
            p = np.where(phi > 0, c * (a + b) + two + other, c * a + two)
            q = np.where(phi > 0, c * a * b + two * b + other * a, 0)
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = np.where(
                phi > 0,
                np.where(p >= 0, 2 * q / (p + root), (p - root) / (2 * c)),
                p / c,
            )
            guess = x + step
        inside = np.isfinite(guess) & (guess > low) & (guess < high)
        moved = np.where(inside, guess, (low + high) / 2)
        # As near as the value can be computed, or as the bracket allows.
        done = (np.abs(value) <= _EPS * count * (1 + np.abs(terms).sum(axis=1))) | (
            high - low <= 2 * _EPS * np.abs(x)
        )
        x = np.where(done, x, moved)
        if done.all():
            break
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray):
    """Eigendecomposition of vectors @ diag(values) @ vectors.T + update @ update.T.

    Values ascend; columns of ``vectors`` belong to them.
    """
    z = vectors.T @ update
    norm = float(np.sqrt(z @ z))
    # Deflation: an entry that moves nothing beyond rounding keeps its eigenpair, and of equal
    # eigenvalues a rotation leaves only one to be moved.
    limit = 8 * _EPS * max(np.abs(values).max(initial=0.0), norm**2)
    values, vectors, z = values.copy(), vectors.copy(), z.copy()
    last = -1
    for i in range(len(values)):
        if abs(z[i]) * norm <= limit:
            continue
        if last >= 0 and values[i] - values[last] <= limit:
            length = np.hypot(z[last], z[i])
            cosine, sine = z[i] / length, z[last] / length
            first, second = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = cosine * first - sine * second, sine * first + cosine * second
            z[last], z[i] = 0.0, length
        last = i
    moving = np.flatnonzero(np.abs(z) * norm > limit)
    if not len(moving):
        return values, vectors
    poles, weights = values[moving], z[moving]
    near, distance = secular_roots(poles, weights**2)
    # roots[j] - poles[i], without cancellation
    gaps = (poles[near] - poles[:, None]) + distance
    differences = poles[None, :] - poles[:, None]
    np.fill_diagonal(differences, 1.0)
    # Weights for which the roots are exact (Loewner's formula), with the signs of the old ones.
    exact = np.sqrt(np.abs(np.prod(gaps / differences, axis=1)))
    exact = np.where(weights < 0, -exact, exact)
    turned = exact[:, None] / gaps
    turned /= np.sqrt((turned**2).sum(axis=0))
    values[moving] = poles[near] + distance
    vectors[:, moving] = vectors[:, moving] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of some rows."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def _moved(self, n: int, mean: np.ndarray, updates: np.ndarray) -> None:
        """Take in rows of which count, mean and (as rows) a root of the scatter are known."""
        if not n:
            return
        gap = mean - self.mean
        total = self.n + n
        shift = np.sqrt(self.n * n / total) * gap
        for update in [shift, *updates]:
            if update.any():
                self.values, self.vectors = rank_one(self.values, self.vectors, update)
        self.mean = self.mean + gap * (n / total)
        self.n = total

    def add(self, rows: np.ndarray) -> None:
        """Take in rows, a block at a time."""
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            mean = block.mean(axis=0)
            centred = block - mean
            if len(block) > block.shape[1]:
                centred = np.linalg.qr(centred, mode="r")
            self._moved(len(block), mean, centred)

    def merge(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        """Take in another spectrum: its eigenpairs are rank-one updates."""
        self._moved(n, mean, (vectors * np.sqrt(np.maximum(values, 0))).T)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole vectors as rows without the shift, filled up with what a zero becomes."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) - SHIFT
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    found = np.zeros((len(sizes), width))
    found[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return found


def _partials(width: int):
    def run(batches):
        spectrum = Spectrum(width)
        for batch in batches:
            spectrum.add(_matrix(batch.column(0), width))
        if spectrum.n:
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [TaskContext.get().partitionId()],
                    "n": [spectrum.n],
                    "mean": [spectrum.mean],
                    "values": [spectrum.values],
                    "vectors": [spectrum.vectors.ravel()],
                }
            )

    return run


def _combined(width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        spectrum = Spectrum(width)
        for row in group.sort_values("part").itertuples():
            spectrum.merge(row.n, row.mean, row.values, np.reshape(row.vectors, (width, width)))
        return pd.DataFrame(
            {
                "part": [int(group["part"].min()) // FAN],
                "n": [spectrum.n],
                "mean": [spectrum.mean],
                "values": [spectrum.values],
                "vectors": [spectrum.vectors.ravel()],
            }
        )

    return run


def combined_spectrum(whole: DataFrame, width: int) -> Spectrum:
    """The spectrum of all rows of ``x``; each round leaves a FAN-th of the partial ones."""
    parts = pin(whole.select("x").mapInArrow(_partials(width), _PARTIAL), "spectra")
    while parts.agg(F.max("part")).first()[0] > 0:
        parts = pin(
            parts.withColumn("_of", F.floor(F.col("part") / F.lit(FAN)))
            .groupBy("_of")
            .applyInPandas(_combined(width), _PARTIAL),
            "spectra",
        )
    row = parts.first()
    spectrum = Spectrum(width)
    spectrum.n, spectrum.mean = row["n"], np.array(row["mean"])
    spectrum.values = np.array(row["values"])
    spectrum.vectors = np.reshape(row["vectors"], (width, width))
    return spectrum


def _moments(mean: np.ndarray, basis: np.ndarray):
    """Sums and second moments of the centred rows in the basis: one row per entry."""

    def run(batches):
        width = basis.shape[1]
        square, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            part = (_matrix(batch.column(0), len(mean)) - mean) @ basis
            square += part.T @ part
            sums += part.sum(axis=0)
        values = np.concatenate([square.ravel(), sums])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values))), pa.array(values)], ["entry", "value"]
        )

    return run


def second_moments(whole: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(second moments, sums) over all rows: width * (width + 1) numbers for the driver."""
    width = basis.shape[1]
    rows = (
        whole.select("x")
        .mapInArrow(_moments(mean, basis), "entry long, value double")
        .groupBy("entry")
        .agg(F.sum("value").alias("value"))
        .toPandas()
        .sort_values("entry")
    )
    values = rows["value"].to_numpy()
    return values[: width * width].reshape(width, width), values[width * width :]


def _whitened(mean: np.ndarray, basis: np.ndarray, n: int, explained: np.ndarray, error: float):
    """One row per vector and component."""
    count = basis.shape[1]
    numbers = np.arange(1, count + 1, dtype=np.int32)

    def run(batches):
        for batch in batches:
            step = max(1, PORTION // count)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = part.num_rows
                values = (_matrix(part.column(2), len(mean)) - mean) @ basis
                again = pa.array(np.repeat(np.arange(rows), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again),
                        pa.array(np.tile(numbers, rows)),
                        pa.array(np.full(rows * count, n)),
                        part.column(1).take(again),
                        pa.array(values.ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * count, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def whole_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x): the usable vectors with every entry floor(SCALE * c) + SHIFT."""
    x = F.col(vector)
    ok = x.isNotNull() & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    )
    return vectors.where(ok).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(
            x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("long")
        ).alias("x"),
    )


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = vectors.sparkSession
    whole = pin(whole_vectors(vectors, key, vector), "whole")
    n, width = whole.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not width:
        return spark.createDataFrame([], _RESULT)
    # Exact sums per dimension, as many numbers as a vector has.
    sums = dict(
        whole.select(F.posexplode("x").alias("at", "c"))
        .groupBy("at")
        .agg(F.sum((F.col("c") - SHIFT).cast("decimal(38,0)")).alias("s"))
        .collect()
    )
    totals = [int(sums.get(i, 0)) for i in range(width)]
    mean = np.array([float(s) / n for s in totals])

    basis = combined_spectrum(whole, width).vectors
    square, _ = second_moments(whole, mean, basis)
    values, turn = np.linalg.eigh(square / n)
    trace = float(np.trace(square)) / n
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > NOTHING * trace]
    if not len(order):
        return spark.createDataFrame([], _RESULT)
    kept = basis @ turn[:, order]
    # A product of orthogonal matrices is orthonormal but for rounding; one step mends that.
    kept = kept @ (1.5 * np.eye(len(order)) - 0.5 * kept.T @ kept)
    largest = kept[np.abs(kept).argmax(axis=0), np.arange(len(order))]
    kept = kept * np.where(largest < 0, -1.0, 1.0)
    scaled = kept / np.sqrt(values[order])

    again, added = second_moments(whole, mean, scaled)
    covariance = again / n - np.outer(added / n, added / n)
    error = float(np.abs(covariance - np.eye(len(order))).max())

    # n * x - S is the same with and without the shift.
    exact = F.array(*[F.lit(s).cast("decimal(38,0)") for s in totals])
    padded = F.concat(
        "x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x"))
    )
    gaps = F.zip_with(
        padded,
        exact,
        lambda c, t: (
            (c - F.lit(SHIFT)).cast("decimal(18,0)") * F.lit(n).cast("decimal(18,0)") - t
        ).cast("decimal(19,0)"),
    )
    squares = F.aggregate(
        gaps,
        F.lit(0).cast("decimal(38,0)"),
        lambda total, gap: (total + gap * gap).cast("decimal(38,0)"),
    )
    return whole.select("vec_id", squares.cast("long").alias("deviation"), "x").mapInArrow(
        _whitened(mean, scaled, n, values[order] / trace, error), _RESULT
    )


def op13_embedding_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whiten(table(spark, directory, "embeddings").select("vec_id", "embedding"))
