"""Tail probabilities, applied to result tables of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def two_sided_normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def two_sided_sign_p(a: int, b: int) -> float:
    """Exact two-sided binomial(a + b, 1/2) test.

    The tail is summed outwards from its largest term; terms shrink fast, so
    the sum needs about sqrt(a + b) of them.
    """
    n, k = a + b, min(a, b)
    if n == 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total = 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2.0 * total)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: two_sided_normal_p(v) if pd.notna(v) else None).astype("float64")


@F.pandas_udf(DoubleType())
def sign_test_p(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([two_sided_sign_p(int(x), int(y)) for x, y in zip(a, b)], dtype="float64")
