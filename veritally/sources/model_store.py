"""Saving and loading fitted models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from veritally.operators.encoding import Encoding
from veritally.operators.models import RiskModel


def save_model(spark: SparkSession, model: RiskModel, path: str) -> str:
    """The pipeline in MLlib's format plus a one-row table of slot names."""
    model.pipeline().write().overwrite().save(f"{path}/pipeline")
    meta = json.dumps({"key": model.key, "names": model.encoding.names, "parents": model.encoding.parents})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_model(spark: SparkSession, path: str) -> RiskModel:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    stages = PipelineModel.load(f"{path}/pipeline").stages
    encoding = Encoding(stages[0] if len(stages) == 2 else PipelineModel(stages[:-1]), meta["names"], meta["parents"])
    return RiskModel(meta["key"], encoding, stages[-1])
