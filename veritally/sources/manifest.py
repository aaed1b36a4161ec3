"""Run manifest: what a run did, as append-only rows."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.sources.tables import file_digests

SCHEMA = "run_id string, kind string, name string, payload string, recorded timestamp"


class RunManifest:
    """Stages, row counts, gates and files of one run in a shared Parquet table."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id

    def _append(self, kind: str, name: str, payload: dict) -> None:
        row = (self.run_id, kind, name, json.dumps(payload, sort_keys=True, default=str), datetime.now(timezone.utc))
        self.spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(self.path)

    def record_stage(self, name: str, **payload) -> None:
        self._append("stage", name, payload)

    def record_rows(self, name: str, n: int) -> None:
        self._append("rows", name, {"n": int(n)})

    def record_gates(self, gates: DataFrame) -> None:
        """One manifest row per gate, written by the executors."""
        payload = F.to_json(F.struct("passed", "fatal", "detail"))
        gates.select(
            F.lit(self.run_id).alias("run_id"),
            F.lit("gate").alias("kind"),
            "name",
            payload.alias("payload"),
            F.current_timestamp().alias("recorded"),
        ).write.mode("append").parquet(self.path)

    def record_files(self, label: str, path: str) -> None:
        payload = F.to_json(F.struct("path", "bytes", "sha256"))
        file_digests(self.spark, path).select(
            F.lit(self.run_id).alias("run_id"),
            F.lit("file").alias("kind"),
            F.lit(label).alias("name"),
            payload.alias("payload"),
            F.current_timestamp().alias("recorded"),
        ).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("run_id") == self.run_id)


def written_rows(spark: SparkSession, path: str) -> int:
    """Row count of a table just written, taken from its Parquet footers.

    An Observation would save this look, but once a session has one, fitted
    MLlib models can no longer be shipped to executors (Spark 4.1).
    """
    return spark.read.parquet(path).count()
