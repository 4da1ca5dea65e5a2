"""Pandas UDFs around the tail functions; they run on result tables, one row per test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmark.functions.normality import shapiro_tail
from proofmark.functions.tails import (
    chi_square_upper,
    f_upper,
    mann_whitney_two_sided,
    student_two_sided,
)
from proofmark.functions.tails import student_critical as student_quantile


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) for a, b in zip(t, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def student_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_quantile(a, b) for a, b in zip(p, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_upper(a, b) for a, b in zip(x, dof)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_two_sided(*row) for row in zip(u, n1, n2, ties)], dtype=float)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    return pd.Series([f_upper(*row) for row in zip(f, between, within)], dtype=float)


@F.pandas_udf(T.DoubleType())
def shapiro_p(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([shapiro_tail(a, b) for a, b in zip(w, n)], dtype=float)
