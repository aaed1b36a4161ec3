"""Whole-table evaluation of a long scored table (row_id, model, y, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.bootstrap import bootstrap_ci, bootstrap_difference
from veritally.operators.bounded import bounded, stored
from veritally.operators.calibration import calibration_metrics
from veritally.operators.discrimination import decision_curve, discrimination_metrics
from veritally.operators.inference import compare_models, mcnemar_test, wide_scores
from veritally.operators.ladder import score_ladder
from veritally.operators.thresholds import classification_metrics, long_thresholds, select_thresholds


def performance_table(
    scored: DataFrame, row_id: str = "row_id", n_resamples: int = 2000, seed: int = 42, mode: str = "exact"
) -> DataFrame:
    """One row per model: bootstrap intervals of three metrics, calibration, log loss."""
    ladder = stored(score_ladder(scored, ["model"]))
    ci = bootstrap_ci(scored, ["model"], row_id, n_resamples=n_resamples, seed=seed, mode=mode)
    wide = ci.groupBy("model").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(c))).alias(m if c == "estimate" else f"{m}_{c}")
            for m in ("auroc", "auprc", "brier")
            for c in ("estimate", "ci_low", "ci_high", "se")
        ]
    )
    disc = discrimination_metrics(ladder, ["model"]).select("model", "auprc_baseline", "log_loss")
    cal = calibration_metrics(ladder, ["model"]).drop("brier")
    return wide.join(bounded(disc), "model").join(bounded(cal), "model")


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest AUROC, first name on ties."""
    ordered = F.struct((-F.col("auroc")).alias("worst"), F.col("model").alias("m"))
    return metrics.agg(F.min_by("model", ordered).alias("best_model"), F.max("auroc").alias("auroc"))


def threshold_table(
    dev: DataFrame, holdout: DataFrame, capacity: float = 0.10, target_sensitivity: float = 0.50
) -> DataFrame:
    """Operating points from development scores, judged on hold-out scores."""
    points = long_thresholds(select_thresholds(score_ladder(dev, ["model"]), ["model"], capacity, target_sensitivity), ["model"])
    return classification_metrics(score_ladder(holdout, ["model"]), points, ["model"])


def comparison_table(
    scored: DataFrame,
    models: list[str],
    primary: tuple[str, str],
    thresholds: DataFrame,
    row_id: str = "row_id",
    n_resamples: int = 2000,
    seed: int = 42,
    metric: str = "auprc",
    mode: str = "exact",
) -> dict[str, DataFrame]:
    """DeLong with Holm for all pairs, and for the primary pair a paired difference and McNemar."""
    cut = {r["model"]: r["capacity"] for r in thresholds.select("model", "capacity").where(F.col("model").isin(*primary)).collect()}
    wide = wide_scores(scored, list(primary), row_id)
    a, b = primary
    return {
        "pairs": compare_models(scored, models, primary, row_id),
        "difference": bootstrap_difference(scored, a, b, metric, row_id, n_resamples, seed=seed, mode=mode),
        "mcnemar": mcnemar_test(wide, F.col(a), F.col(b), cut[a], cut[b]),
    }


def decision_curves(scored: DataFrame, grid: list[float] | None = None) -> DataFrame:
    return decision_curve(score_ladder(scored, ["model"]), ["model"], grid)
