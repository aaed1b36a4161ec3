"""The trial store: one append-only Parquet table for every search.

Parameters are kept as text, drawn and fixed ones alike, so that a refit from
the store uses the model that was scored. The objective of every fold is kept
for the pruner of a resumed search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = (
    "study string, trial int, state string, value double, auroc double, folds int, "
    "fold_values array<double>, params map<string,string>, started timestamp, completed timestamp"
)


def as_text(params: dict) -> dict[str, str]:
    return {k: v if isinstance(v, str) else repr(float(v)) for k, v in params.items() if v is not None}


def from_text(params: dict[str, str] | None) -> dict:
    """The parameters as ``as_text`` got them: numbers as floats, all else as text."""
    out: dict = {}
    for k, v in (params or {}).items():
        try:
            out[k] = float(v)
        except ValueError:
            out[k] = v
    return out


class TrialStore:
    """Trials of any number of studies. A lost run loses at most the trial in flight."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, trials: DataFrame) -> None:
        trials.write.mode("append").partitionBy("study").parquet(self.path)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def complete_folds(self, study: str) -> dict[int, list[float]]:
        """The fold values of a study's complete trials, by trial; a search has few of them by design."""
        rows = self.read().where((F.col("study") == study) & (F.col("state") == "COMPLETE")).select("trial", "fold_values").collect()
        return {r["trial"]: list(r["fold_values"]) for r in rows}

    def finished(self) -> DataFrame:
        """study, trial of attempted trials: complete and pruned ones use up the budget."""
        return self.read().where(F.col("state").isin("COMPLETE", "PRUNED")).select("study", "trial").distinct()


def unfinished(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """Planned (study, trial) rows without a finished record."""
    return planned.join(finished.select("study", "trial"), ["study", "trial"], "left_anti")
