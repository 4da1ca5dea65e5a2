"""Shapiro-Wilk W and p (Royston 1995, algorithm AS R94) as expressions over sums.

W needs each value's normal score, which depends on its place only; everything else is a
sum.  So groups of any size are tested whole.  The p-value is calibrated for 3 to 5000
values and extrapolated beyond.
"""

from __future__ import annotations

from math import asin, exp, log, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions.tails import normal_upper

# The published polynomial coefficients of AS R94, constant term first.
FIRST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)

# The rational forms of the normal quantile of AS 241 (PPND16), constant first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def _horner(coefficients, x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def with_normal_score(df: DataFrame, place: Column, n: Column, name: str) -> DataFrame:
    """Add Blom's score of the value at ``place`` (from 1) of ``n``.

    The steps are columns of their own: put into one expression, each polynomial would repeat
    all that its argument is made of, and the generated code would be too long to compile.
    """
    p, q, r, near = (f"{name}_{step}" for step in ("p", "q", "r", "near"))
    return (
        df.withColumn(p, (place.cast("double") - 0.375) / (n.cast("double") + 0.25))
        .withColumns({q: F.col(p) - 0.5, r: F.sqrt(-F.log(F.least(F.col(p), 1.0 - F.col(p))))})
        .withColumn(
            near,
            F.when(F.abs(q) <= 0.425, 0.180625 - F.col(q) * F.col(q))
            .when(F.col(r) <= 5.0, F.col(r) - 1.6)
            .otherwise(F.col(r) - 5.0),
        )
        .withColumn(
            name,
            F.when(
                F.abs(q) <= 0.425,
                F.col(q) * _horner(CENTRE[0], F.col(near)) / _horner(CENTRE[1], F.col(near)),
            )
            .when(
                F.col(r) <= 5.0,
                F.signum(q) * _horner(MIDDLE[0], F.col(near)) / _horner(MIDDLE[1], F.col(near)),
            )
            .otherwise(F.signum(q) * _horner(TAIL[0], F.col(near)) / _horner(TAIL[1], F.col(near))),
        )
        .drop(p, q, r, near)
    )


def with_shapiro_w(
    df: DataFrame, n: str, products: str, squares: str, spread: str, ends: list[str]
) -> DataFrame:
    """Add ``shapiro_w`` from sums over one group a row.

    ``products``: scores times values; ``squares``: squared scores; ``spread``: squared
    deviations; ``ends``: the first, second, last but one and last value.
    """
    count = F.col(n).cast("double")
    scored = with_normal_score(df, count, count, "_s1")
    scored = with_normal_score(scored, count - 1, count, "_s2")
    scored = scored.withColumns({"_size": 1.0 / F.sqrt(count), "_root": F.sqrt(squares)}).withColumns(
        {
            "_a1": F.col("_s1") / F.col("_root") + _horner(FIRST_WEIGHT, F.col("_size")),
            "_a2": F.col("_s2") / F.col("_root") + _horner(SECOND_WEIGHT, F.col("_size")),
            "_outer": F.col(ends[3]) - F.col(ends[0]),
            "_inner": F.col(ends[2]) - F.col(ends[1]),
        }
    )

    def total(leading: list[tuple[str, str, str]]) -> Column:
        """Leading weights as given, the scores of the rest scaled to unit length."""
        of = lambda name: F.col(name)
        taken = sum((2.0 * of(s) * of(s) for _, s, _ in leading), F.lit(0.0))
        held = sum((2.0 * of(a) * of(a) for a, _, _ in leading), F.lit(0.0))
        rest = F.col(products) - sum((of(s) * of(gap) for _, s, gap in leading), F.lit(0.0))
        scale = F.sqrt((F.col(squares) - taken) / (1.0 - held))
        return sum((of(a) * of(gap) for a, _, gap in leading), F.lit(0.0)) + F.try_divide(rest, scale)

    summed = (
        F.when(count == 3, F.lit(sqrt(0.5)) * F.col("_outer"))
        .when(count <= 5, total([("_a1", "_s1", "_outer")]))
        .otherwise(total([("_a1", "_s1", "_outer"), ("_a2", "_s2", "_inner")]))
    )
    scored = scored.withColumn("_summed", summed)
    w = F.least(F.lit(1.0), F.try_divide(F.col("_summed") * F.col("_summed"), F.col(spread)))
    return scored.withColumn("shapiro_w", F.when(F.col(spread) == 0, F.lit(1.0)).otherwise(w)).drop(
        "_s1", "_s2", "_size", "_root", "_a1", "_a2", "_outer", "_inner", "_summed"
    )


def _poly(coefficients, x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def shapiro_tail(w: float, n: float) -> float:
    """p of a finished W."""
    if w is None or n is None or w != w or n < 3:
        return float("nan")
    if w >= 1.0:
        return 1.0
    if n == 3:
        return max(0.0, 6.0 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    y, size = log(1.0 - w), log(n)
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if y >= gamma:
            return 0.0
        y, mean, sd = -log(gamma - y), _poly(SMALL_MEAN, n), exp(_poly(SMALL_LOG_SD, n))
    else:
        mean, sd = _poly(LARGE_MEAN, size), exp(_poly(LARGE_LOG_SD, size))
    return normal_upper((y - mean) / sd)
