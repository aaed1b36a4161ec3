"""Operating thresholds and the classification profile at a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.operators.bounded import bounded
from veritally.operators.ladder import ladder_quantiles


def select_thresholds(
    ladder: DataFrame, keys: list[str], capacity: float = 0.10, target_sensitivity: float = 0.50
) -> DataFrame:
    """keys, capacity, youden, fixed_sensitivity: one row per key group.

    capacity flags the top share of rows, youden maximises sensitivity +
    specificity (highest score on ties, 1.0 if no score beats flagging nobody),
    fixed_sensitivity is the highest score that reaches the target.
    """
    if not keys:
        return select_thresholds(ladder.withColumn("_all", F.lit(0)), ["_all"], capacity, target_sensitivity).drop("_all")
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    sens = F.try_divide(tp, F.greatest(F.col("pos_total"), F.lit(1)))
    j = F.round(F.try_divide(tp, F.col("pos_total")) - F.try_divide(fp, F.col("neg_total")), 12)
    points = ladder.groupBy(*keys).agg(
        F.max(F.struct(j.alias("j"), F.col("p").alias("p"))).alias("_best"),
        F.max(F.when(sens >= target_sensitivity, F.col("p"))).alias("_fixed"),
        F.min("p").alias("_min"),
    )
    top = ladder_quantiles(ladder, keys, [1 - capacity], "_q")
    return points.join(bounded(top), keys).select(
        *keys,
        F.col("_q")[0].alias("capacity"),
        F.when(F.col("_best.j") > 0, F.least(F.greatest(F.col("_best.p"), F.lit(0.0)), F.lit(1.0)))
        .otherwise(F.lit(1.0))
        .alias("youden"),
        F.coalesce("_fixed", "_min").alias("fixed_sensitivity"),
    )


def long_thresholds(wide: DataFrame, keys: list[str]) -> DataFrame:
    """keys, operating_point, threshold."""
    points = ["capacity", "youden", "fixed_sensitivity"]
    pairs = [F.struct(F.lit(p).alias("operating_point"), F.col(p).alias("threshold")) for p in points]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def classification_metrics(
    ladder: DataFrame, thresholds: DataFrame, keys: list[str], extra: list[str] | None = None
) -> DataFrame:
    """Confusion counts and ratios per threshold row; a score at the threshold is flagged.

    ``thresholds`` has some or all of the keys, ``threshold`` and the label
    columns named in ``extra``. Undefined ratios are null, an undefined F1 is 0.
    """
    extra = ["operating_point"] if extra is None else extra
    on = [k for k in keys if k in thresholds.columns]
    joined = ladder.join(bounded(thresholds), on)
    hit = F.col("p") >= F.col("threshold")

    def total(column: str, flag) -> Column:
        return F.sum(F.when(flag, F.col(column)).otherwise(F.lit(0)))

    counts = joined.groupBy(*keys, *extra, "threshold").agg(
        total("neg", ~hit).alias("tn"),
        total("neg", hit).alias("fp"),
        total("pos", ~hit).alias("fn"),
        total("pos", hit).alias("tp"),
    )
    return counts.select(*keys, *extra, "threshold", "tn", "fp", "fn", "tp", *ratio_columns())


def ratio_columns() -> list:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    ppv = F.try_divide(tp, tp + fp)
    return [
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        ppv.alias("ppv"),
        F.try_divide(tn, tn + fn).alias("npv"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce((sens + spec) / 2, sens, spec).alias("balanced_accuracy"),
        F.try_divide(tp + tn, n).alias("accuracy"),
        F.try_divide(tp + fp, n).alias("alert_rate"),
        F.when(ppv > 0, 1 / ppv).alias("nne"),
    ]
