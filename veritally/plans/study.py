"""From raw encounters to evaluation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.bounded import stored
from veritally.operators.gates import enforce
from veritally.operators.leakage import mean_prediction_gates, split_gates
from veritally.operators.models import RiskModel, fit_model, score_models
from veritally.operators.split import ColumnRoles, column_roles, stratified_split
from veritally.plans import hospital


@dataclass
class Study:
    matrix: DataFrame
    roles: ColumnRoles
    models: dict[str, RiskModel]
    development: DataFrame
    holdout: DataFrame


def prepare(raw: DataFrame, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, ColumnRoles]:
    """Analysis matrix with ``split``, and the column roles learned once on all of it."""
    matrix, _ = hospital.analysis_matrix(hospital.cohort(raw))
    matrix = stored(stratified_split(matrix, hospital.TARGET, hospital.ROW_ID, test_size, seed))
    roles = column_roles(matrix, [hospital.TARGET, hospital.ROW_ID, "split"])
    return matrix, roles


def fit_and_score(
    matrix: DataFrame, roles: ColumnRoles, params: dict[str, dict], seed: int = 42, strict: bool = False
) -> Study:
    """Fit each named model on development rows and score both parts.

    Development scores are in-sample. ``strict`` raises when the prevalence of the
    two parts differs too much.
    """
    dev = matrix.where(F.col("split") == "development")
    hold = matrix.where(F.col("split") == "holdout")
    if strict:
        enforce(split_gates(matrix, hospital.TARGET))
    models = {
        key: fit_model(
            key,
            dev,
            roles,
            hospital.TARGET,
            p,
            seed,
            features=hospital.PARSIMONIOUS if key == "parsimonious_lr" else None,
        )
        for key, p in params.items()
    }
    keep = [hospital.ROW_ID, F.col(hospital.TARGET).alias("y"), *hospital.FAIRNESS]
    fitted = list(models.values())
    return Study(
        matrix,
        roles,
        models,
        stored(score_models(fitted, dev, keep)),
        stored(score_models(fitted, hold, keep)),
    )


def prediction_check(study: Study) -> DataFrame:
    return mean_prediction_gates(study.holdout)
