"""Development / hold-out split, folds, role inference, sample size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.operators.bounded import bounded
from veritally.operators.row_index import stratified_index


def development_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """label, n_dev: development rows per class by largest remainder.

    The hold-out takes ceil(test_size * n) rows in total.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = Window.partitionBy()
    share = F.col("_n") * F.col("_dev") / F.col("_total")
    return (
        sizes.withColumn("_total", F.sum("_n").over(classes))
        .withColumn("_dev", F.col("_total") - F.ceil(F.lit(float(test_size)) * F.col("_total")))
        .withColumn("_floor", F.floor(share))
        .withColumn("_left", F.col("_dev") - F.sum("_floor").over(classes))
        .withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(share - F.floor(share)), label)))
        .select(label, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).alias("n_dev"))
    )


def stratified_split(df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: exact class counts, rows chosen by keyed hash."""
    quotas = bounded(development_quotas(df, label, test_size))
    indexed = stratified_index(df, [label], row_id, seed, "split")
    return (
        indexed.join(quotas, label)
        .withColumn("split", F.when(F.col("idx") <= F.col("n_dev"), "development").otherwise("holdout"))
        .drop("idx", "stratum_n", "n_dev")
    )


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """One row per (row, repeat) with ``repeat`` and ``fold``, class-balanced in every repeat."""
    repeated = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    indexed = stratified_index(repeated, ["repeat", label], row_id, seed, "fold", hash_on=["repeat", row_id])
    return indexed.withColumn("fold", F.pmod(F.col("idx") - 1, F.lit(k)).cast("int")).drop("idx", "stratum_n")


def grouped_folds(df: DataFrame, entity: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds that keep all rows of an entity together."""
    from veritally.functions.hashing import key_hash

    return df.withColumn("fold", F.pmod(key_hash(seed, "group-fold", entity), F.lit(k)).cast("int"))


def first_training_fold(folded: DataFrame) -> DataFrame:
    """Training part of the first fold of the first repeat."""
    return folded.where((F.col("repeat") == 0) & (F.col("fold") != 0))


@dataclass
class ColumnRoles:
    """Which features are continuous and which categorical, with their distinct counts."""

    continuous: list[str]
    categorical: list[str]
    levels: dict[str, int] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.continuous, *self.categorical]

    def only(self, columns: list[str]) -> "ColumnRoles":
        absent = [c for c in columns if c not in self.features]
        if absent:
            raise KeyError(f"features not in the table: {absent}")
        return ColumnRoles(
            [c for c in self.continuous if c in columns],
            [c for c in self.categorical if c in columns],
            {c: n for c, n in self.levels.items() if c in columns},
        )

    def without(self, columns: list[str]) -> "ColumnRoles":
        return self.only([c for c in self.features if c not in columns])

    @property
    def n_parameters(self) -> int:
        return len(self.continuous) + sum(max(self.levels[c] - 1, 1) for c in self.categorical)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n_distinct: value counts first, so a unique column is never one group."""
    from veritally.operators.features import long_levels

    return (
        long_levels(df, columns)
        .where(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(F.lit(1).alias("_one"))
        .groupBy("variable")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def column_roles(df: DataFrame, exclude: list[str]) -> ColumnRoles:
    """Numeric columns with more than two distinct values are continuous, all others categorical."""
    columns = [f for f in df.schema.fields if f.name not in exclude]
    found = {r["variable"]: r["n_distinct"] for r in distinct_counts(df, [f.name for f in columns]).collect()}
    levels = {f.name: found.get(f.name, 0) for f in columns}
    continuous = [f.name for f in columns if isinstance(f.dataType, T.NumericType) and levels[f.name] > 2]
    categorical = [f.name for f in columns if f.name not in continuous]
    return ColumnRoles(continuous, categorical, levels)


def sample_size(df: DataFrame, target: str, n_parameters: int) -> DataFrame:
    """Minimum sample size for a binary prediction model (criteria 1 and 3) and events per parameter."""
    counts = df.agg(F.count(F.lit(1)).alias("n_available"), F.sum(F.col(target).cast("bigint")).alias("events"))
    return sample_size_from_counts(counts, n_parameters)


def sample_size_from_counts(counts: DataFrame, n_parameters: int) -> DataFrame:
    # Shrinkage 0.9, 15% of the maximal Cox-Snell R2, margin 0.05.
    pi = F.col("events") / F.col("n_available")
    max_r2 = 1 - F.pow(F.pow(pi, pi) * F.pow(1 - pi, 1 - pi), F.lit(2))
    c1 = n_parameters / (F.lit(0.9 - 1) * F.log(1 - 0.15 * max_r2 / 0.9))
    c3 = F.lit((1.96 / 0.05) ** 2) * pi * (1 - pi)
    return counts.select(
        "n_available",
        "events",
        pi.alias("prevalence"),
        F.lit(n_parameters).cast("bigint").alias("candidate_parameters"),
        F.round(F.col("events") / max(n_parameters, 1), 2).alias("events_per_parameter"),
        F.round(c1, 1).alias("minimum_n_criterion1"),
        F.round(c3, 1).alias("minimum_n_criterion3"),
        F.round(F.greatest(c1, c3), 1).alias("minimum_n_required"),
        (F.col("n_available") >= F.greatest(c1, c3)).alias("adequate"),
    )
