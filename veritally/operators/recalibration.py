"""Cross-validated recalibration inside the development rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions.columns import logit, sigmoid
from veritally.operators.bounded import bounded, stored
from veritally.operators.calibration import logistic_fits
from veritally.operators.ladder import score_cells, score_ladder
from veritally.operators.models import MODELS, fit_model
from veritally.operators.smoothing import isotonic_pools, isotonic_values
from veritally.operators.split import ColumnRoles, stratified_folds


def platt_fits(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, intercept, slope of logit(y) ~ a + b p with smoothed targets, all groups at once.

    With P positives and N negatives the targets are (P + 1) / (P + 2) and 1 / (N + 2).
    """
    cells = score_cells(scored, keys)
    sizes = bounded(cells.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N")))
    joined = cells.join(sizes, keys)
    high, low = (F.col("_P") + 1) / (F.col("_P") + 2), 1 / (F.col("_N") + 2)
    pos = F.col("pos") * high + F.col("neg") * low
    total = F.col("pos") + F.col("neg")
    return logistic_fits(stored(joined), keys, F.col("p"), pos, total - pos).select(*keys, "intercept", "slope")


def apply_platt(scored: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Scored rows with p replaced by its calibrated value."""
    return (
        scored.join(bounded(fits), keys)
        .withColumn("p", sigmoid(F.col("intercept") + F.col("slope") * F.col("p")))
        .drop("intercept", "slope")
    )


def calibrated_scores(
    key: str,
    dev: DataFrame,
    holdout: DataFrame,
    roles: ColumnRoles,
    target: str,
    row_id: str,
    params: dict | None = None,
    method: str = "sigmoid",
    k: int = 5,
    seed: int = 42,
    features: list[str] | None = None,
) -> DataFrame:
    """row_id, y, model, p: hold-out scores averaged over k calibrated fold models.

    The sigmoid is fitted on log odds for linear models, on p for tree ensembles.
    """
    folded = stored(stratified_folds(dev, target, row_id, k, 1, seed))
    out_of_fold, ahead = None, None
    for f in range(k):
        model = fit_model(key, folded.where(F.col("fold") != f), roles, target, params, seed, features)
        inside = model.score(folded.where(F.col("fold") == f), [F.col(target).alias("y")]).withColumn("fold", F.lit(f))
        outside = model.score(holdout, [row_id, F.col(target).alias("y")]).withColumn("fold", F.lit(f))
        out_of_fold = inside if out_of_fold is None else out_of_fold.unionByName(inside)
        ahead = outside if ahead is None else ahead.unionByName(outside)
    out_of_fold = stored(out_of_fold)
    if method == "sigmoid":
        if MODELS[key].linear:  # a linear model's decision value is its log odds
            ahead, out_of_fold = (t.withColumn("p", logit(F.col("p"))) for t in (ahead, out_of_fold))
        adjusted = apply_platt(ahead, platt_fits(out_of_fold, ["fold"]), ["fold"])
    elif method == "isotonic":
        pools = isotonic_pools(score_ladder(out_of_fold, ["fold"]), ["fold"])
        adjusted = isotonic_values(ahead, pools, ["fold"])
    else:
        raise ValueError(f"unknown method {method!r}")
    return (
        adjusted.groupBy(row_id, "y")
        .agg(F.avg("p").alias("p"))
        .select(row_id, "y", F.lit(f"{key}_calibrated").alias("model"), "p")
    )
