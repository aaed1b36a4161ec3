"""Discrimination metrics and curves, read off the score ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.columns import clip_probability
from veritally.operators.ladder import add_bucket


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def auroc() -> Column:
    """Aggregate over ladder rows; null when a class is absent."""
    area = F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2))
    return F.try_divide(area, F.max(_d("pos_total")) * F.max(_d("neg_total")))


def average_precision() -> Column:
    """Step-wise average precision: precision at each score, weighted by the recall it adds."""
    tp = _d("pos_total") - _d("pos_below")
    fp = _d("neg_total") - _d("neg_below")
    return F.try_divide(F.sum(_d("pos") * F.try_divide(tp, tp + fp)), F.max(_d("pos_total")))


def prevalence() -> Column:
    return F.try_divide(F.sum(_d("pos")), F.sum(_d("pos") + _d("neg")))


def log_loss() -> Column:
    p = clip_probability(F.col("p"))
    return F.try_divide(F.sum(-(_d("pos") * F.log(p) + _d("neg") * F.log(1 - p))), F.sum(_d("pos") + _d("neg")))


def brier() -> Column:
    p = F.col("p")
    return F.try_divide(F.sum(_d("pos") * (1 - p) ** 2 + _d("neg") * p**2), F.sum(_d("pos") + _d("neg")))


def scaled_brier() -> Column:
    pi = prevalence()
    return 1 - F.try_divide(brier(), pi * (1 - pi))


def mean_prediction() -> Column:
    return F.try_divide(F.sum((_d("pos") + _d("neg")) * F.col("p")), F.sum(_d("pos") + _d("neg")))


# Every metric by name; a bootstrap or an arm table picks from here.
METRICS = {
    "auroc": auroc,
    "auprc": average_precision,
    "auprc_baseline": prevalence,
    "log_loss": log_loss,
    "brier": brier,
    "brier_scaled": scaled_brier,
    "mean_predicted_risk": mean_prediction,
}


def ladder_metrics(ladder: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """The named metrics per key group, all in one aggregation."""
    return ladder.groupBy(*keys).agg(*[METRICS[m]().alias(m) for m in names or METRICS])


def discrimination_metrics(ladder: DataFrame, keys: list[str]) -> DataFrame:
    return ladder_metrics(ladder, keys, ["auroc", "auprc", "auprc_baseline", "log_loss"])


def roc_points(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, fpr, tpr when everything scored at least p is flagged."""
    return ladder.select(
        *keys,
        "p",
        F.try_divide(_d("neg_total") - _d("neg_below"), _d("neg_total")).alias("fpr"),
        F.try_divide(_d("pos_total") - _d("pos_below"), _d("pos_total")).alias("tpr"),
    )


def pr_points(ladder: DataFrame, keys: list[str]) -> DataFrame:
    tp = _d("pos_total") - _d("pos_below")
    fp = _d("neg_total") - _d("neg_below")
    return ladder.select(
        *keys, "p", F.try_divide(tp, _d("pos_total")).alias("recall"), F.try_divide(tp, tp + fp).alias("precision")
    )


def score_histogram(ladder: DataFrame, keys: list[str], bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Equal-width counts; the last bin is closed, scores outside the range are left out."""
    width = (high - low) / bins
    inside = ladder.where(F.col("p").between(low, high))
    number = F.least(F.floor((F.col("p") - low) / width), F.lit(bins - 1))
    return inside.groupBy(*keys, number.alias("bin")).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))


def decision_grid(low: float = 0.01, high: float = 0.30, step: float = 0.005) -> list[float]:
    """Threshold probabilities as clean multiples of the step."""
    per_unit = round(1 / step)
    return [k / per_unit for k in range(round(low * per_unit), round(high * per_unit) + 1)]


def decision_curve(ladder: DataFrame, keys: list[str], grid: list[float] | None = None) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none over a grid.

    Scores are first counted per grid interval; the grid is then applied to
    those few counts.
    """
    grid = grid or decision_grid()
    binned = add_bucket(ladder, "p", grid, "_b").groupBy(*keys, "_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    flagged = F.col("_b") >= F.col("i")
    counted = (
        binned.select(*keys, "_b", "_pos", "_neg", F.inline(steps))
        .groupBy(*keys, "threshold")
        .agg(
            F.sum(F.when(flagged, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(flagged, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum("_pos").alias("_p"),
            F.sum(F.col("_pos") + F.col("_neg")).alias("_n"),
        )
    )
    odds = F.col("threshold") / (1 - F.col("threshold"))
    pi = F.col("_p") / F.col("_n")
    return counted.select(
        *keys,
        "threshold",
        (F.col("tp") / F.col("_n") - F.col("fp") / F.col("_n") * odds).alias("net_benefit_model"),
        (pi - (1 - pi) * odds).alias("net_benefit_treat_all"),
        F.lit(0.0).alias("net_benefit_treat_none"),
        (F.col("tp") + F.col("fp")).alias("n_flagged"),
    )
