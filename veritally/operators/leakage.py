"""Checks that no identifier, outcome proxy or shared row slips into a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.features import numeric_columns
from veritally.operators.gates import Gate, evaluate_gates


def forbidden_present(df: DataFrame, forbidden: list[str]) -> list[str]:
    return sorted(set(forbidden) & set(df.columns))


def surviving_exclusions(cohort: DataFrame, raw: DataFrame, row_id: str, column: str, codes: list) -> DataFrame:
    """Cohort rows whose raw record carries an excluded code; must be empty."""
    return cohort.join(raw.where(F.col(column).isin(codes)).select(row_id), row_id, "left_semi")


def target_correlations(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """variable, r: Pearson correlation with the target, all columns in one scan."""
    columns = columns or [c for c in numeric_columns(df) if c != target]
    y = F.col(target).cast("double")
    wide = df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), y).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("r")) for c in columns]
    return wide.select(F.inline(F.array(*pairs)))


def near_perfect(df: DataFrame, target: str, limit: float = 0.95, columns: list[str] | None = None) -> DataFrame:
    return target_correlations(df, target, columns).where(F.abs("r") > limit)


def shared_ids(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Ids present on both sides (fatal when any)."""
    return left.select(row_id).join(right.select(row_id), row_id, "left_semi").distinct()


def identical_rows(left: DataFrame, right: DataFrame, features: list[str]) -> DataFrame:
    """n_identical: distinct feature rows found on both sides (a warning, not an error).

    Only 64-bit row hashes are shuffled, and each side is made distinct first.
    """
    row_hash = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in features])).alias("_h")
    both = left.select(row_hash).distinct().join(right.select(row_hash).distinct(), "_h", "left_semi")
    return both.agg(F.count(F.lit(1)).alias("n_identical"))


def split_report(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """split, n, events, prevalence."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(target).cast("bigint")).alias("events"),
        F.avg(F.col(target).cast("double")).alias("prevalence"),
    )


def split_gates(df: DataFrame, target: str, tolerance: float = 0.002) -> DataFrame:
    """Prevalence of development and hold-out rows must agree."""
    y = F.col(target).cast("double")
    stats = df.agg(
        F.avg(F.when(F.col("split") == "development", y)).alias("dev"),
        F.avg(F.when(F.col("split") == "holdout", y)).alias("hold"),
    )
    gap = F.abs(F.col("dev") - F.col("hold"))
    return evaluate_gates(
        stats, [Gate("split_prevalence_match", gap < tolerance, F.format_string("gap = %.6f", gap))]
    )


def mean_prediction_gates(scored: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Mean predicted risk against prevalence, per model."""
    stats = scored.groupBy("model").agg(F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("prevalence"))
    return stats.select(
        "model",
        "mean_p",
        "prevalence",
        (F.abs(F.col("mean_p") - F.col("prevalence")) < tolerance).alias("passed"),
    )


def auroc_ceiling(metrics: DataFrame, ceiling: float = 0.75, fatal: bool = True) -> DataFrame:
    """An AUROC above the plausible ceiling points to leakage."""
    best = metrics.agg(F.max("auroc").alias("best"))
    return evaluate_gates(
        best, [Gate("auroc_plausible", F.col("best") <= ceiling, F.format_string("best = %.6f", F.col("best")), fatal)]
    )


def recorded_gates(manifest: DataFrame, required: dict[str, str], fatal: bool = True) -> DataFrame:
    """One gate per required manifest record (name to kind): what a run claims must have been written.

    Use it to require, say, the development scores behind the thresholds and the
    fitted encoders of all models.
    """
    seen = [F.count_if((F.col("name") == n) & (F.col("kind") == k)).alias(f"n{i}") for i, (n, k) in enumerate(required.items())]
    gates = [
        Gate(f"recorded_{n}", F.col(f"n{i}") > 0, F.format_string(f"{k} {n}: %d", F.col(f"n{i}")), fatal)
        for i, (n, k) in enumerate(required.items())
    ]
    return evaluate_gates(manifest.agg(*seen), gates)
