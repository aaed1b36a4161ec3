"""The five risk models as MLlib estimators, their search spaces, fit and score."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.hashing import key_uniform
from veritally.operators.encoding import Encoding, drop_helpers, fit_encoding
from veritally.operators.split import ColumnRoles


@dataclass
class ModelSpec:
    key: str
    display_name: str
    family: str
    features: list[str] | None = None
    space: list[tuple] = field(default_factory=list)

    @property
    def linear(self) -> bool:
        return self.family == "linear"


# Search spaces as (name, kind, low, high[, step]) or (name, "choice", values).
SPACES: dict[str, list[tuple]] = {
    "penalised_lr": [("C", "log", 1e-4, 1e2), ("l1_ratio", "linear", 0.0, 1.0)],
    "random_forest": [
        ("max_depth", "int", 6, 18),
        ("min_samples_leaf", "logint", 15, 120),
        ("max_features", "choice", ["sqrt", "log2", "0.3", "0.5"]),
    ],
    "boosted_depthwise": [
        ("n_estimators", "step", 200, 1200, 100),
        ("learning_rate", "log", 0.01, 0.3),
        ("max_depth", "int", 3, 10),
        ("min_child_weight", "log", 1.0, 20.0),
        ("subsample", "linear", 0.6, 1.0),
        ("colsample", "linear", 0.6, 1.0),
        ("reg_lambda", "log", 1e-3, 10.0),
    ],
    "boosted_leafwise": [
        ("n_estimators", "step", 200, 1200, 100),
        ("learning_rate", "log", 0.01, 0.3),
        ("num_leaves", "logint", 15, 255),
        ("min_child_samples", "logint", 5, 100),
        ("subsample", "linear", 0.6, 1.0),
        ("colsample", "linear", 0.6, 1.0),
        ("reg_lambda", "log", 1e-3, 10.0),
    ],
}

MODELS: dict[str, ModelSpec] = {
    "parsimonious_lr": ModelSpec("parsimonious_lr", "Parsimonious logistic regression", "linear"),
    "penalised_lr": ModelSpec("penalised_lr", "Penalised logistic regression", "linear", space=SPACES["penalised_lr"]),
    "random_forest": ModelSpec("random_forest", "Random forest", "tree", space=SPACES["random_forest"]),
    "boosted_depthwise": ModelSpec("boosted_depthwise", "Boosted trees A", "tree", space=SPACES["boosted_depthwise"]),
    "boosted_leafwise": ModelSpec("boosted_leafwise", "Boosted trees B", "tree", space=SPACES["boosted_leafwise"]),
}


def draw_parameter(kind_spec: tuple, uniform: Column) -> Column:
    """A search-space value as text-free column for one uniform draw."""
    _, kind, *rest = kind_spec
    if kind == "choice":
        values = F.array(*[F.lit(v) for v in rest[0]])
        return F.element_at(values, (F.floor(uniform * len(rest[0])) + 1).cast("int"))
    low, high = float(rest[0]), float(rest[1])
    if kind == "linear":
        return F.lit(low) + uniform * (high - low)
    if kind == "log":
        return F.exp(F.lit(math.log(low)) + uniform * (math.log(high) - math.log(low)))
    if kind == "int":
        return F.floor(F.lit(low) + uniform * (high - low + 1)).cast("double")
    if kind == "step":
        step = float(rest[2])
        return F.lit(low) + step * F.floor(uniform * ((high - low) / step + 1))
    if kind == "logint":
        top = math.log(high + 0.5) - math.log(low - 0.5)
        drawn = F.round(F.exp(F.lit(math.log(low - 0.5)) + uniform * top), 0)
        return F.least(F.greatest(drawn, F.lit(low)), F.lit(high))
    raise ValueError(f"unknown kind {kind!r}")


def candidate_points(trials: DataFrame, trial: str, space: list[tuple], seed: int = 42) -> DataFrame:
    """One candidate per trial id: the trial column and one column per parameter."""
    return trials.select(
        trial, *[draw_parameter(s, key_uniform(seed, f"space-{s[0]}", trial)).alias(s[0]) for s in space]
    )


def forest_depth(params: dict) -> int:
    """MLlib's forests have at most 30 levels; more can't be had and isn't cut without a word."""
    depth = int(params.get("max_depth", 30))
    if depth > 30:
        raise ValueError(f"max_depth {depth} is beyond the 30 levels that MLlib's forests have")
    return depth


def make_estimator(key: str, params: dict | None, n_weight: float, seed: int = 42, weighted: bool = False):
    """An unfitted MLlib classifier on ``features`` / ``label``.

    ``n_weight`` is the total training weight: the penalty C multiplies a sum of
    losses, MLlib's regParam a mean.
    """
    p = dict(params or {})
    common = {"featuresCol": "features", "labelCol": "label"}
    if weighted:
        common["weightCol"] = "weight"
    if key == "parsimonious_lr":
        return LogisticRegression(regParam=0.0, standardization=False, maxIter=200, tol=1e-9, **common)
    if key == "penalised_lr":
        return LogisticRegression(
            regParam=1.0 / (float(p.get("C", 1.0)) * n_weight),
            elasticNetParam=float(p.get("l1_ratio", 0.5)),
            standardization=False,
            maxIter=int(p.get("max_iter", 200)),
            tol=1e-7,
            **common,
        )
    if key == "random_forest":
        return RandomForestClassifier(
            numTrees=int(p.get("n_estimators", 500)),
            maxDepth=forest_depth(p),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            featureSubsetStrategy=str(p.get("max_features", "sqrt")),
            maxBins=64,
            seed=seed,
            **common,
        )
    if key in ("boosted_depthwise", "boosted_leafwise"):
        if key == "boosted_depthwise":
            depth, least = int(p.get("max_depth", 5)), max(1, round(float(p.get("min_child_weight", 1.0))))
        else:
            depth = max(1, math.ceil(math.log2(float(p.get("num_leaves", 31)))))
            least = int(p.get("min_child_samples", 20))
        return GBTClassifier(
            maxIter=int(p.get("n_estimators", 500)),
            stepSize=float(p.get("learning_rate", 0.05)),
            maxDepth=depth,
            minInstancesPerNode=least,
            subsamplingRate=float(p.get("subsample", 0.9)),
            featureSubsetStrategy=str(float(p.get("colsample", 0.9))),
            maxBins=64,
            seed=seed,
            **common,
        )
    raise KeyError(f"unknown model {key!r}")


@dataclass
class RiskModel:
    """An encoder and a classifier fitted together."""

    key: str
    encoding: Encoding
    classifier: object

    def pipeline(self) -> PipelineModel:
        return PipelineModel([self.encoding.model, self.classifier])

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep..., model, p."""
        scored = self.classifier.transform(self.encoding.transform(df))
        return scored.select(
            *keep, F.lit(self.key).alias("model"), vector_to_array("probability")[1].alias("p")
        )


def fit_model(
    key: str,
    train: DataFrame,
    roles: ColumnRoles,
    target: str,
    params: dict | None = None,
    seed: int = 42,
    features: list[str] | None = None,
    weight: str | None = None,
) -> RiskModel:
    """Encode and fit on the training rows. A listed feature that is absent raises."""
    encoding, encoded, total = encode_training(key, train, roles, target, features, weight)
    estimator = make_estimator(key, params, total, seed, weighted=bool(weight))
    # Learners pass over their input many times: keep it encoded for the length of the fit.
    encoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return RiskModel(key, encoding, estimator.fit(encoded))
    finally:
        encoded.unpersist()


def encode_training(
    key: str,
    train: DataFrame,
    roles: ColumnRoles,
    target: str,
    features: list[str] | None = None,
    weight: str | None = None,
) -> tuple[Encoding, DataFrame, float]:
    """The fitted encoder, the encoded rows (features, label, weight) and their total weight."""
    used = roles.only(features) if features is not None else roles
    spec = MODELS[key]
    columns = [*used.features, target, *([weight] if weight else [])]
    rows = train.select(*columns).withColumn("label", F.col(target).cast("double"))
    if weight:
        rows = rows.withColumnRenamed(weight, "weight")
        total = rows.agg(F.sum("weight").alias("w")).first()["w"]
    else:
        total = float(rows.count())
    encoding = fit_encoding(rows, used, scale=spec.linear, drop_first=spec.linear)
    encoded = drop_helpers(encoding.transform(rows)).select("features", "label", *(["weight"] if weight else []))
    return encoding, encoded, total


def score_models(models: list[RiskModel], df: DataFrame, keep: list[str]) -> DataFrame:
    """Long scored table of several models over the same rows."""
    out = models[0].score(df, keep)
    for m in models[1:]:
        out = out.unionByName(m.score(df, keep))
    return out


def wide_predictions(scored: DataFrame, row_id: str, target: str, models: list[str], keep: list[str]) -> DataFrame:
    """One row per scored row with one probability column per model."""
    return scored.groupBy(row_id, target, *keep).pivot("model", models).agg(F.first("p"))
