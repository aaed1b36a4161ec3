"""Data-driven feature steps: screens, level collapsing, imputation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.functions.columns import unknown_if_missing
from veritally.operators.bounded import bounded
from veritally.operators.gates import Gate, evaluate_gates
from veritally.operators.quantiles import exact_quantiles


def long_levels(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows (keep..., variable, level) for the named columns, levels as text."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns]
    return df.select(*(keep or []), F.inline(F.array(*pairs)))


def long_numbers(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return df.select(*(keep or []), F.inline(F.array(*pairs)))


def active_share(df: DataFrame, columns: list[str], inactive: str = "No") -> DataFrame:
    """variable, share of rows that differ from the inactive value; one scan for all."""
    shares = df.agg(*[F.avg((~F.col(f"`{c}`").eqNullSafe(inactive)).cast("int")).alias(c) for c in columns])
    return shares.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("active_share")) for c in columns])
        )
    )


def near_zero_variance(df: DataFrame, columns: list[str], threshold: float, inactive: str = "No") -> list[str]:
    """Columns to drop; at most one row per column comes to the driver."""
    rows = active_share(df, columns, inactive).where(F.col("active_share") < threshold).collect()
    return [r["variable"] for r in rows]


def level_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, level, n, share among the non-null rows of the variable."""
    counts = (
        long_levels(df, columns).where(F.col("level").isNotNull()).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("variable").agg(F.sum("n").alias("_total"))
    return counts.join(bounded(totals), "variable").select(
        "variable", "level", "n", (F.col("n") / F.col("_total")).alias("share")
    )


def collapse_rare(
    df: DataFrame,
    columns: list[str],
    threshold: float = 0.01,
    keep_top: int | None = None,
    other: str = "Other",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Levels with a share below ``threshold`` (or outside the top ``keep_top``) become ``other``.

    Only the levels that stay are brought to the driver: there can be no more
    than 1/threshold of them per column, however many rare ones exist.
    """
    if keep_top is None and threshold <= 0:
        return df  # every level has that share
    shares = level_shares(fit_on if fit_on is not None else df, columns)
    if keep_top is not None:
        w = Window.partitionBy("variable").orderBy(F.desc("n"), "level")
        kept = shares.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep_top)
        most = keep_top * len(columns)
    else:
        kept = shares.where(F.col("share") >= threshold)
        most = math.ceil(1 / threshold) * len(columns)  # so many levels can have that share
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in kept.select("variable", "level").limit(most + 1).collect():
        levels[r["variable"]].append(r["level"])
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull() | F.col(c).cast("string").isin(levels[c]), F.col(c)).otherwise(other)
            for c in columns
        }
    )


def explicit_unknown(df: DataFrame, tokens: list[str], columns: list[str] | None = None) -> DataFrame:
    """Missing tokens and nulls of string columns become an Unknown level; no row leaves."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: unknown_if_missing(F.col(f"`{c}`"), tokens) for c in columns}) if columns else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute_median(df: DataFrame, columns: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill numeric nulls with the exact column median, of ``fit_on`` if given."""
    columns = columns or numeric_columns(df)
    nulls = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in columns]).first()
    gaps = [c for c in columns if nulls[c]]
    if not gaps:
        return df
    found = exact_quantiles(long_numbers(df if fit_on is None else fit_on, gaps), "value", [0.5], keys=["variable"]).collect()
    fills = {r["variable"]: r["q"][0] for r in found}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in fills.items()})


def completeness_gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row count unchanged and no null left."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in after.columns), F.lit(0))
    sides = before.select(F.lit(1).alias("_before"), F.lit(0).alias("_after"), F.lit(0).cast("bigint").alias("_null")).unionAll(
        after.select(F.lit(0), F.lit(1), nulls)
    )
    stats = sides.agg(
        F.coalesce(F.sum("_before"), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("_after"), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("missing"),
    )
    return evaluate_gates(
        stats,
        [
            Gate("no_row_deletion", F.col("n_after") == F.col("n_before"), F.concat(F.lit("rows = "), F.col("n_after"))),
            Gate("zero_missing", F.col("missing") == 0, F.concat(F.lit("missing = "), F.col("missing"))),
        ],
    )


def code_labels(df: DataFrame, column: str, labels: DataFrame, out: str, default: str = "Unknown") -> DataFrame:
    """Left join on a code table (code, label); codes without a label get ``default``."""
    side = bounded(labels.select(F.col("code").alias(column), F.col("label").alias(out)))
    return df.join(side, column, "left").withColumn(out, F.coalesce(out, F.lit(default)))

