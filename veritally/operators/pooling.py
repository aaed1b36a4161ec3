"""Pooling of estimates over imputed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_quantile(z: float, df: Column) -> Column:
    """The t quantile that belongs to the normal quantile ``z``, by its expansion in 1 / df; for df of 3 or more."""
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    )
    out = F.lit(z)
    for k, t in enumerate(terms, 1):
        out = out + F.lit(t) / F.pow(df, F.lit(k))
    return out


def pooled(estimates: DataFrame, keys: list[str], z: float = 1.959963984540054) -> DataFrame:
    """keys, draws, estimate, within, between, se, df, ci_low, ci_high, missing_share of (keys, draw, estimate, variance).

    The variance of the mean over m draws is the mean variance within a draw plus (1 + 1 / m) times the variance between
    draws. Intervals use the t distribution with the matching degrees of freedom; draws that agree give the normal one.
    One draw has no variance between.
    """
    m = F.count("estimate")
    sums = estimates.groupBy(*keys).agg(
        m.alias("draws"), F.avg("estimate").alias("estimate"), F.avg("variance").alias("within"), F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("between")
    )
    extra = (1 + 1 / F.col("draws")) * F.col("between")
    total = F.col("within") + extra
    share = F.try_divide(extra, total)
    df = F.try_divide((F.col("draws") - 1).cast("double"), share * share)
    out = sums.withColumns({"se": F.sqrt(total), "df": df, "missing_share": share})
    quantile = F.when(F.col("df").isNull(), F.lit(z)).otherwise(t_quantile(z, F.col("df")))
    half = F.col("se") * quantile
    return out.withColumns({"ci_low": F.col("estimate") - half, "ci_high": F.col("estimate") + half})
