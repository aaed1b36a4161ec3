"""Importance measures: Shapley values, permutation, gain, and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.functions.hashing import key_hash
from veritally.operators.bounded import bounded, scratch_path, stored
from veritally.operators.discrimination import ladder_metrics
from veritally.operators.encoding import parent_features
from veritally.operators.ladder import score_ladder
from veritally.operators.row_index import stratified_index


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest keyed hashes."""
    return df.orderBy(key_hash(seed, "sample", row_id), row_id).limit(n)


def linear_shap(
    rows: DataFrame, row_id: str, vector: str, coefficients: list[float], background_rows: int | None = None, seed: int = 42
) -> DataFrame:
    """row_id, phi: coefficient times distance from the mean, per slot.

    The mean is over all rows, or over a sample of ``background_rows``.
    """
    values = rows.select(row_id, F.col(vector).cast("array<double>").alias("v"))
    background = values if background_rows is None else sample_rows(values, row_id, background_rows, seed)
    size = len(coefficients)
    means = background.agg(*[F.avg(F.element_at("v", i + 1)).alias(f"m{i}") for i in range(size)]).first()
    weights = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(float(means[i])).alias("m")) for i, c in enumerate(coefficients)])
    return values.select(row_id, F.zip_with("v", weights, lambda x, w: w["c"] * (x - w["m"])).alias("phi"))


def mean_abs_shap(phis: DataFrame, names: list[str], originals: list[str]) -> DataFrame:
    """feature, mean_abs_shap, rank_shap: mean |phi| per slot, summed per source column."""
    per_slot = phis.agg(*[F.avg(F.abs(F.element_at("phi", i + 1))).alias(f"s{i}") for i in range(len(names))])
    pairs = [F.struct(F.lit(n).alias("encoded_feature"), F.col(f"s{i}").alias("value")) for i, n in enumerate(names)]
    long = parent_features(per_slot.select(F.inline(F.array(*pairs))), originals)
    return ranked(long.groupBy("feature").agg(F.sum("value").alias("mean_abs_shap")), "mean_abs_shap", "rank_shap")


def ranked(table: DataFrame, by: str, out: str) -> DataFrame:
    """Rank a feature table (one row per source column) by a measure, largest first."""
    w = Window.partitionBy().orderBy(F.desc(by), "feature")
    return bounded(table).withColumn(out, F.row_number().over(w))


# --- tree Shapley values -----------------------------------------------------


def tree_nodes(spark: SparkSession, model) -> tuple[pd.DataFrame, np.ndarray]:
    """Node table of a fitted tree ensemble and the weight of each tree.

    Read from the model's own saved form; its size is set by the model, not by
    the data.
    """
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select(
        F.col("treeID").alias("tree"),
        "nodeData.id",
        "nodeData.prediction",
        F.col("nodeData.rawCount").cast("double").alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("threshold"),
        F.col("nodeData.split.numCategories").alias("categories"),
        F.col("nodeData.impurityStats").alias("stats"),
    ).toPandas()
    return nodes, np.array(model.treeWeights, dtype="float64")


def _leaf_paths(nodes: pd.DataFrame, weights: np.ndarray, classify: bool) -> list[dict]:
    """Per leaf: weighted value, and per feature on its path the interval or categories and the share of cover that follows it."""
    leaves = []
    for tree, part in nodes.groupby("tree"):
        table = {r["id"]: r for r in part.to_dict("records")}
        scale = weights[int(tree)]
        if classify:
            scale = 1.0 / len(weights)
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = table[at]
            if node["left"] < 0:
                value = node["prediction"]
                if classify:
                    value = node["stats"][1] / max(sum(node["stats"]), 1e-300)
                leaves.append({"value": scale * value, "path": path})
                continue
            f = int(node["feature"])
            named = node["categories"] >= 0  # such a split sends listed categories to the left
            cut = {float(c) for c in node["threshold"]} if named else float(node["threshold"][0])
            for child, is_left in ((node["left"], True), (node["right"], False)):
                low, high, share, allowed = path.get(f, (-np.inf, np.inf, 1.0, None))
                share *= table[child]["cover"] / node["cover"]
                if named:
                    allowed = set(map(float, range(int(node["categories"])))) if allowed is None else allowed
                    allowed = allowed & cut if is_left else allowed - cut
                else:
                    low, high = (low, min(high, cut)) if is_left else (max(low, cut), high)
                stack.append((child, {**path, f: (low, high, share, allowed)}))
    return leaves


def _shapley(x: np.ndarray, leaves: list[dict]) -> np.ndarray:
    """Path-dependent Shapley values of an ensemble for a block of rows."""
    phi = np.zeros_like(x, dtype="float64")
    for leaf in leaves:
        features = list(leaf["path"])
        d = len(features)
        if not d:
            continue
        lows, highs, shares = (np.array([leaf["path"][f][i] for f in features]) for i in range(3))
        followed = ((x[:, features] > lows) & (x[:, features] <= highs)).astype("float64")
        for m, f in enumerate(features):
            if leaf["path"][f][3] is not None:
                followed[:, m] *= np.isin(x[:, f], list(leaf["path"][f][3]))
        for j in range(d):
            # poly[s] sums, over coalitions of s other features, follow x share products
            poly = np.zeros((len(x), d))
            poly[:, 0] = 1.0
            for m in range(d):
                if m != j:
                    grown = poly * shares[m]
                    grown[:, 1:] += poly[:, :-1] * followed[:, [m]]
                    poly = grown
            size = np.arange(d)
            weight = np.array([1.0 / (d * comb(d - 1, int(s))) for s in size])
            phi[:, features[j]] += leaf["value"] * (followed[:, j] - shares[j]) * (poly @ weight)
    return phi


def tree_shap(encoded: DataFrame, row_id: str, model, features: str = "features") -> DataFrame:
    """row_id, phi, base: Shapley values of the raw ensemble output.

    ``phi`` summed plus ``base`` gives the raw margin of boosted trees (half the
    log odds) or the class-1 probability of a forest.
    """
    nodes, weights = tree_nodes(encoded.sparkSession, model)
    classify = "GBT" not in type(model).__name__
    leaves = _leaf_paths(nodes, weights, classify)
    base = float(sum(leaf["value"] * np.prod([step[2] for step in leaf["path"].values()]) for leaf in leaves))
    shared = encoded.sparkSession.sparkContext.broadcast(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            phi = _shapley(np.array(batch["v"].tolist(), dtype="float64"), shared.value)
            yield pd.DataFrame({row_id: batch[row_id].to_numpy(), "phi": list(phi), "base": base})

    id_type = encoded.schema[row_id].dataType.simpleString()
    return encoded.select(row_id, vector_to_array(features).alias("v")).mapInPandas(
        explain, f"{row_id} {id_type}, phi array<double>, base double"
    )


# --- permutation and gain ----------------------------------------------------


def permuted_rows(df: DataFrame, row_id: str, features: list[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """All rows once per (feature, repeat) with that one feature shuffled.

    A repeat has one order for all features: position i of the hash order hands its values to
    position i of the id order. Both orders are numbered in parallel and meet in one equi-join
    per repeat; the copies of a row for each feature are made after it, where the row lies, so
    what is shuffled doesn't grow with the number of features.
    """
    base = stored(stratified_index(df, [], row_id, seed, "permutation-base")).drop("stratum_n")
    reps = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("rep")
    new = F.struct(*[F.col(f"`{f}`") for f in features]).alias("_new")
    givers = base.select(F.col(row_id).alias("_giver"), new, reps)
    turned = stratified_index(givers, ["rep"], "_giver", seed, "permutation", hash_on=["rep", "_giver"]).drop("stratum_n", "_giver")
    # sizes are estimated without the repeats, so a plain join could broadcast all of them through the driver
    joined = base.select("*", reps).hint("merge").join(turned, ["rep", "idx"]).drop("idx")
    moved = joined.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    return moved.withColumns(
        {f: F.when(F.col("feature") == f, F.col("_new").getField(f)).otherwise(F.col(f"`{f}`")) for f in features}
    ).drop("_new")


def permutation_importance(
    df: DataFrame,
    row_id: str,
    target: str,
    features: list[str],
    score: Callable[[DataFrame], DataFrame],
    repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """feature, permutation_importance, permutation_sd, rank_permutation.

    ``score`` adds column p to a table; the importance is the fall in AUROC,
    with the population SD over the repeats.
    """
    rows = df.withColumn("y", F.col(target))
    whole = ladder_metrics(score_ladder(score(rows).select("y", "p"), []), [], ["auroc"]).first()["auroc"]
    shuffled = score(permuted_rows(rows, row_id, features, repeats, seed)).select("feature", "rep", "y", "p")
    drops = ladder_metrics(score_ladder(shuffled, ["feature", "rep"]), ["feature", "rep"], ["auroc"])
    table = drops.groupBy("feature").agg(
        F.avg(F.lit(whole) - F.col("auroc")).alias("permutation_importance"),
        F.stddev_pop(F.lit(whole) - F.col("auroc")).alias("permutation_sd"),
    )
    return ranked(table, "permutation_importance", "rank_permutation")


def gain_importance(model, names: list[str], originals: list[str], spark) -> DataFrame:
    """feature, gain_importance, rank_gain: impurity gains summed per source column."""
    gains = model.featureImportances.toArray()
    table = spark.createDataFrame(list(zip(names, map(float, gains))), "encoded_feature string, value double")
    long = parent_features(table, originals)
    return ranked(long.groupBy("feature").agg(F.sum("value").alias("gain_importance")), "gain_importance", "rank_gain")


def compare_ranks(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of ``rank_<name>`` columns with rank_disagreement = max - min."""
    parts = [t.select("feature", f"rank_{name}") for name, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, "feature", "full_outer"), parts)
    ranks: list[Column] = [F.col(f"rank_{name}") for name in tables]
    gap = (F.greatest(*ranks) - F.least(*ranks)) if len(ranks) > 1 else F.lit(0)
    return joined.withColumn("rank_disagreement", gap)


def top_ranked(table: DataFrame, by: str, n: int = 15) -> DataFrame:
    return table.orderBy(F.col(by).asc_nulls_last(), "feature").limit(n)
