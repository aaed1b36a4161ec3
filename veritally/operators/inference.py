"""DeLong, McNemar and Holm: tests on scored tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.special import normal_p, sign_test_p
from veritally.operators.bounded import BROADCAST_ROWS, bounded, stored
from veritally.operators.ladder import BUCKET_ROWS, MAX_BUCKETS, add_bucket, balanced_edges, score_ladder
from veritally.operators.running import running

HOT_ROWS = 100_000


def midranks(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, midrank: average position of the rows that share a score."""
    below, here = F.col("pos_below") + F.col("neg_below"), F.col("pos") + F.col("neg")
    return ladder.select(*keys, "p", (below + (here + 1) / 2).alias("midrank"))


def join_ladder(rows: DataFrame, ladder: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """Rows with ladder columns of their own score.

    A ladder of proven small size is broadcast. Otherwise the few scores shared
    by very many rows are broadcast and only the rest is shuffled on the score,
    so no task receives all rows of a common score.
    """
    side = ladder.select(*keys, "p", *columns, (F.col("pos") + F.col("neg")).alias("_rows"))
    on = [*keys, "p"]
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.drop("_rows")), on)
    hot = bounded(side.where(F.col("_rows") > HOT_ROWS).drop("_rows"))
    common = rows.join(hot, on)
    rest = rows.join(hot.select(*on), on, "left_anti").join(side.where(F.col("_rows") <= HOT_ROWS).drop("_rows"), on)
    return common.unionByName(rest)


def placements(scored: DataFrame, row_id: str = "row_id") -> DataFrame:
    """row_id, y, model, v: share of the other class ranked on the right side of the row."""
    ladder = stored(score_ladder(scored, ["model"]))
    won = (F.col("neg_below") + F.col("neg") / 2) / F.col("neg_total")
    lost = 1 - (F.col("pos_below") + F.col("pos") / 2) / F.col("pos_total")
    rows = scored.select(row_id, "y", "model", F.col("p").cast("double").alias("p"))
    joined = join_ladder(rows, ladder, ["model"], [won.alias("_won"), lost.alias("_lost")])
    return joined.select(row_id, "y", "model", F.when(F.col("y") == 1, F.col("_won")).otherwise(F.col("_lost")).alias("v"))


def auc_variances(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc, variance: the placement variance of each group's AUROC, in one aggregation over its ladder."""
    won = (F.col("neg_below") + F.col("neg") / 2) / F.col("neg_total")
    lost = 1 - (F.col("pos_below") + F.col("pos") / 2) / F.col("pos_total")
    sums = ladder.groupBy(*keys).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_q"),
        F.sum(F.col("pos") * won).alias("_w"), F.sum(F.col("pos") * won * won).alias("_ww"),
        F.sum(F.col("neg") * lost).alias("_l"), F.sum(F.col("neg") * lost * lost).alias("_ll"),
    )
    spread = lambda n, x, xx: F.try_divide(F.col(xx) - F.col(x) * F.col(x) / F.col(n), F.col(n) - 1)
    variance = spread("_p", "_w", "_ww") / F.col("_p") + spread("_q", "_l", "_ll") / F.col("_q")
    return sums.select(*keys, (F.col("_w") / F.col("_p")).alias("auroc"), variance.alias("variance"))


def delong_moments(scored: DataFrame, models: list[str], row_id: str = "row_id") -> DataFrame:
    """y, model_a, model_b, n, mean_a, mean_b, var_a, var_b, cov over the placements."""
    place = placements(scored.where(F.col("model").isin(models)), row_id)
    wide = place.groupBy(row_id, "y").agg(
        *[F.max(F.when(F.col("model") == m, F.col("v"))).alias(f"v{i}") for i, m in enumerate(models)]
    )
    used = range(len(models))
    stats = wide.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"v{i}").alias(f"mean{i}") for i in used],
        *[F.var_samp(f"v{i}").alias(f"var{i}") for i in used],
        *[F.covar_samp(f"v{i}", f"v{j}").alias(f"cov{i}_{j}") for i, j in combinations(used, 2)],
    )
    pairs = [
        F.struct(
            F.lit(models[i]).alias("model_a"),
            F.lit(models[j]).alias("model_b"),
            F.col(f"mean{i}").alias("mean_a"),
            F.col(f"mean{j}").alias("mean_b"),
            F.col(f"var{i}").alias("var_a"),
            F.col(f"var{j}").alias("var_b"),
            F.col(f"cov{i}_{j}").alias("cov"),
        )
        for i, j in combinations(used, 2)
    ]
    return stats.select("y", "n", F.inline(F.array(*pairs)))


def delong_test(scored: DataFrame, models: list[str], row_id: str = "row_id") -> DataFrame:
    """All model pairs: auc_a, auc_b, difference, se, z, p_value, ci_low, ci_high.

    A difference without variance has null se, z, p and interval.
    """
    m = delong_moments(scored, models, row_id)

    def at(y: int, c: str) -> Column:
        return F.max(F.when(F.col("y") == y, F.col(c)))

    var = (at(1, "var_a") + at(1, "var_b") - 2 * at(1, "cov")) / at(1, "n") + (
        at(0, "var_a") + at(0, "var_b") - 2 * at(0, "cov")
    ) / at(0, "n")
    pairs = m.groupBy("model_a", "model_b").agg(
        at(1, "mean_a").alias("auc_a"), at(1, "mean_b").alias("auc_b"), var.alias("_var")
    )
    diff, se = F.col("auc_a") - F.col("auc_b"), F.when(F.col("_var") > 1e-24, F.sqrt("_var"))
    out = bounded(
        pairs.select(
            "model_a",
            "model_b",
            "auc_a",
            "auc_b",
            diff.alias("difference"),
            se.alias("se"),
            (diff / se).alias("z"),
            (diff - 1.96 * se).alias("ci_low"),
            (diff + 1.96 * se).alias("ci_high"),
        )
    )
    return out.withColumn("p_value", normal_p("z"))


def wide_scores(scored: DataFrame, models: list[str], row_id: str = "row_id") -> DataFrame:
    """row_id, y and one score column per model."""
    return scored.where(F.col("model").isin(models)).groupBy(row_id, "y").agg(
        *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(m) for m in models]
    )


def mcnemar_counts(wide: DataFrame, a: Column, b: Column, threshold_a, threshold_b, label: str = "y") -> DataFrame:
    """n01 (only a right), n10 (only b right) and the corrected statistic, from one scan."""
    thr = [t if isinstance(t, Column) else F.lit(float(t)) for t in (threshold_a, threshold_b)]
    right_a = (a >= thr[0]).cast("int") == F.col(label)
    right_b = (b >= thr[1]).cast("int") == F.col(label)
    counts = wide.agg(F.count_if(right_a & ~right_b).alias("n01"), F.count_if(~right_a & right_b).alias("n10"))
    n01, n10 = F.col("n01"), F.col("n10")
    stat = F.try_divide((F.abs(n01 - n10) - 1) * (F.abs(n01 - n10) - 1), n01 + n10)
    return counts.select("n01", "n10", F.coalesce(stat, F.lit(0.0)).alias("statistic"))


def mcnemar_test(wide: DataFrame, a: Column, b: Column, threshold_a, threshold_b, label: str = "y") -> DataFrame:
    """McNemar counts with the exact two-sided p-value."""
    counts = bounded(mcnemar_counts(wide, a, b, threshold_a, threshold_b, label), 1)
    return counts.withColumn("p_value", sign_test_p("n01", "n10"))


def holm(
    tests: DataFrame, p: str, order_id: str, family: list[str] | None = None, out: str = "p_adjusted", buckets: int | None = None
) -> DataFrame:
    """Holm step-down adjustment inside each family; a null or NaN p counts as 1.

    Positions and the running maximum are carried over p-value buckets, so a
    family of any length is never sorted in one task.
    """
    if not family:
        return holm(tests.withColumn("_all", F.lit(0)), p, order_id, ["_all"], out, buckets).drop("_all")
    clean = tests.withColumn("_p", F.when(F.col(p).isNull() | F.isnan(p), F.lit(1.0)).otherwise(F.col(p).cast("double")))
    sizes = bounded(clean.groupBy(*family).agg(F.count(F.lit(1)).alias("_m")))
    if buckets is None:
        largest = sizes.agg(F.max("_m").alias("n")).first()["n"] or 0
        buckets = min(MAX_BUCKETS, -(-largest // BUCKET_ROWS))
    bucket = None
    if buckets > 1:
        clean = add_bucket(clean, "_p", balanced_edges(clean, "_p", buckets), "_pb")
        bucket = F.col("_pb")
    ranked = running(clean, family, bucket, ["_p", order_id], sums={"_rank": F.lit(1)})
    ranked = ranked.join(sizes, family)
    step = (F.col("_m") - F.col("_rank") + 1) * F.col("_p")
    done = running(ranked.withColumn("_step", step), family, bucket, ["_p", order_id], maxes={out: F.col("_step")})
    return done.withColumn(out, F.least(F.lit(1.0), out)).drop("_p", "_pb", "_rank", "_m", "_step")


def compare_models(
    scored: DataFrame, models: list[str], primary: tuple[str, str] | None = None, row_id: str = "row_id"
) -> DataFrame:
    """DeLong for every pair; the primary pair keeps its p, the others are Holm-adjusted."""
    tests = delong_test(scored, models, row_id)
    if primary is None:
        is_primary = F.lit(False)
    else:
        a, b = primary
        is_primary = ((F.col("model_a") == a) & (F.col("model_b") == b)) | ((F.col("model_a") == b) & (F.col("model_b") == a))
        flip = (F.col("model_a") == b) & (F.col("model_b") == a)
        turned = {
            "model_a": F.when(flip, F.lit(a)).otherwise(F.col("model_a")),
            "model_b": F.when(flip, F.lit(b)).otherwise(F.col("model_b")),
            "auc_a": F.when(flip, F.col("auc_b")).otherwise(F.col("auc_a")),
            "auc_b": F.when(flip, F.col("auc_a")).otherwise(F.col("auc_b")),
            "difference": F.when(flip, -F.col("difference")).otherwise(F.col("difference")),
            "z": F.when(flip, -F.col("z")).otherwise(F.col("z")),
            "ci_low": F.when(flip, -F.col("ci_high")).otherwise(F.col("ci_low")),
            "ci_high": F.when(flip, -F.col("ci_low")).otherwise(F.col("ci_high")),
        }
        tests = tests.withColumns(turned)
    tests = bounded(
        tests.withColumn("comparison", F.concat_ws(" vs ", "model_a", "model_b")).withColumn(
            "type", F.when(is_primary, "primary").otherwise("secondary")
        )
    )
    return holm(tests, "p_value", "comparison", ["type"])
