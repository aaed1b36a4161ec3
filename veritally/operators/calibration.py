"""Calibration: logistic recalibration fits, binned curve, integrated index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.columns import logit, sigmoid
from veritally.operators.bounded import bounded, small_table, stored
from veritally.operators.ladder import ladder_quantiles
from veritally.operators.smoothing import BLOCK_ROWS, isotonic_index, lowess_index

MAX_STEP = 5.0


def _bounded_step(step: Column) -> Column:
    return F.least(F.greatest(step, F.lit(-MAX_STEP)), F.lit(MAX_STEP))


def logistic_fits(
    cells: DataFrame,
    keys: list[str],
    x: Column,
    pos: Column | None = None,
    neg: Column | None = None,
    steps: int = 40,
    tolerance: float = 1e-6,
    start: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Newton fits for all key groups at once: keys, intercept, slope, offset_intercept.

    ``intercept`` and ``slope`` belong to logit(y) ~ a + b x, ``offset_intercept``
    to logit(y) ~ c + x with c kept in [-10, 10]. Every step is one grouped sum;
    only a few coefficients per group travel. A step that lowers the likelihood is
    halved. Convergence is quadratic, so once a step is shorter than the tolerance
    the error is far below it. Groups with one
    class give nulls.
    """
    if not keys:
        fits = logistic_fits(cells.withColumn("_all", F.lit(0)), ["_all"], x, pos, neg, steps, tolerance, start)
        return fits.drop("_all")
    data = stored(
        cells.select(
            *keys,
            x.alias("_x"),
            (F.col("pos") if pos is None else pos).cast("double").alias("_pos"),
            (F.col("neg") if neg is None else neg).cast("double").alias("_neg"),
        )
    )
    zero = lambda *names: [F.lit(0.0).alias(c) for c in names]
    none = [F.lit(None).cast("double").alias(c) for c in ("l", "lc")]
    state = bounded(
        data.groupBy(*keys)
        .agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
        .where((F.col("_p") > 0) & (F.col("_q") > 0))
        .select(*keys, F.lit(start[0]).alias("a"), F.lit(start[1]).alias("b"), *zero("c", "sa", "sb", "sc"), *none)
    )
    n = F.col("_pos") + F.col("_neg")

    def likelihood(z: Column) -> Column:
        return F.sum(F.col("_pos") * z - n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))

    z, zc = F.col("a") + F.col("b") * F.col("_x"), F.col("c") + F.col("_x")
    q, qc = sigmoid(z), sigmoid(zc)
    r, w = F.col("_pos") - n * q, n * q * (1 - q)
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    da = F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)
    db = F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)
    dc = F.coalesce(F.try_divide(F.col("gc"), F.col("hc")), F.lit(0.0))
    # sa, sb, sc: how far the trial lies from the last accepted point; a trial of lower likelihood goes back by half of it
    worse, worse_c = (F.coalesce(F.col(f"n{x}") < F.col(x) - 1e-12 * F.abs(F.col(x)), F.lit(False)) for x in ("l", "lc"))
    far = {c: F.when(worse, F.col(c) / 2).otherwise(_bounded_step(d)) for c, d in (("sa", da), ("sb", db))}
    to_c = F.least(F.greatest(F.col("c") + _bounded_step(dc), F.lit(-10.0)), F.lit(10.0)) - F.col("c")
    far["sc"] = F.when(worse_c, F.col("sc") / 2).otherwise(to_c)
    trial = {x: F.col(x) + F.when(bad, -far[f"s{x}"]).otherwise(far[f"s{x}"]) for x, bad in (("a", worse), ("b", worse), ("c", worse_c))}
    for _ in range(steps):
        sums = data.join(state, keys).groupBy(*keys, "a", "b", "c", "sa", "sb", "sc", "l", "lc").agg(
            F.sum(r).alias("g0"),
            F.sum(r * F.col("_x")).alias("g1"),
            F.sum(w).alias("h00"),
            F.sum(w * F.col("_x")).alias("h01"),
            F.sum(w * F.col("_x") * F.col("_x")).alias("h11"),
            F.sum(F.col("_pos") - n * qc).alias("gc"),
            F.sum(n * qc * (1 - qc)).alias("hc"),
            likelihood(z).alias("nl"),
            likelihood(zc).alias("nlc"),
        )
        moved = sums.select(
            *keys,
            *[v.alias(c) for c, v in {**trial, **far}.items()],
            F.when(worse, F.col("l")).otherwise(F.col("nl")).alias("l"),
            F.when(worse_c, F.col("lc")).otherwise(F.col("nlc")).alias("lc"),
            F.greatest(*[F.abs(v) for v in far.values()]).alias("moved"),
        )
        table = small_table(moved)
        if table is None:
            kept = stored(moved)
            state = kept.drop("moved")
            longest = kept.agg(F.max(F.when(~F.isnan("moved"), F.col("moved")))).first()[0] or 0.0
        else:
            state = F.broadcast(cells.sparkSession.createDataFrame(table.drop_columns(["moved"]), schema=moved.drop("moved").schema))
            longest = max((m for m in table["moved"].to_pylist() if m is not None and not math.isnan(m)), default=0.0)
        if longest < tolerance:
            break
    everyone = data.select(*keys).distinct()
    return everyone.join(state, keys, "left").select(
        *keys, F.col("a").alias("intercept"), F.col("b").alias("slope"), F.col("c").alias("offset_intercept")
    )


def calibration_fits(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, calibration_slope, calibration_intercept (in the large)."""
    # A perfectly calibrated score has intercept 0 and slope 1: start there.
    fits = logistic_fits(cells, keys, logit(F.col("p")), start=(0.0, 1.0))
    return fits.select(
        *keys, F.col("slope").alias("calibration_slope"), F.col("offset_intercept").alias("calibration_intercept")
    )


def calibration_curve(ladder: DataFrame, keys: list[str], n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """keys, bin, n, mean_predicted, observed, ci_low, ci_high.

    A score equal to an inner edge belongs to the bin below it; repeated edges
    are merged and empty bins left out.
    """
    if strategy == "quantile":
        edges = ladder_quantiles(ladder, keys, [i / n_bins for i in range(n_bins + 1)], "_edges")
        edges = edges.withColumn("_edges", F.array_sort(F.array_distinct("_edges")))
    elif strategy == "uniform":
        low, high = F.min("p"), F.max("p")
        edges = ladder.groupBy(*keys).agg(
            F.array(*[low + (high - low) * F.lit(i / n_bins) for i in range(n_bins)], high).alias("_edges")
        )
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    edges = edges.where(F.size("_edges") > 1).withColumn("_inner", F.slice("_edges", 2, F.size("_edges") - 2))
    binned = ladder.join(bounded(edges), keys).withColumn(
        "bin", F.size(F.filter("_inner", lambda e: e < F.col("p")))
    )
    n = F.col("pos") + F.col("neg")
    stats = binned.groupBy(*keys, "bin").agg(
        F.sum(n).alias("n"),
        (F.sum(n * F.col("p")) / F.sum(n)).alias("mean_predicted"),
        (F.sum("pos") / F.sum(n)).alias("observed"),
    )
    obs = F.col("observed")
    se = F.sqrt(F.greatest(obs * (1 - obs), F.lit(1e-12)) / F.col("n"))
    return stats.select(
        *keys,
        "bin",
        "n",
        "mean_predicted",
        "observed",
        F.greatest(F.lit(0.0), obs - 1.96 * se).alias("ci_low"),
        F.least(F.lit(1.0), obs + 1.96 * se).alias("ci_high"),
    )


# --- integrated calibration index ------------------------------------------


def integrated_calibration_index(
    ladder: DataFrame, keys: list[str], frac: float = 0.6, fit_points: int = 200, method: str = "lowess", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """keys, ici: mean |smoothed observed risk - predicted risk|.

    ``lowess``: the window of a fit point holds the ``frac`` share of nearest rows, exactly, at every size; between
    fit points the curve is linear. ``isotonic``: the non-decreasing fit.
    """
    if method not in ("lowess", "isotonic"):
        raise ValueError(f"unknown method {method!r}")
    if not keys:
        whole = ladder.withColumn("_all", F.lit(0))
        return integrated_calibration_index(whole, ["_all"], frac, fit_points, method, block_rows).drop("_all")
    if method == "isotonic":
        return isotonic_index(ladder, keys, block_rows)
    return lowess_index(ladder, keys, frac, fit_points, block_rows)


def calibration_metrics(ladder: DataFrame, keys: list[str], with_ici: bool = True) -> DataFrame:
    """Slope, intercept, Brier, scaled Brier and the integrated index per key group."""
    from veritally.operators.discrimination import ladder_metrics

    out = bounded(ladder_metrics(ladder, keys, ["brier", "brier_scaled"])).join(calibration_fits(ladder, keys), keys)
    if with_ici:
        out = out.join(integrated_calibration_index(ladder, keys), keys)
    return out
