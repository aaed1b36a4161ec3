"""Eligibility, first record per entity, outcome and participant flow."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.bounded import bounded
from veritally.operators.gates import Gate, evaluate_gates


@dataclass
class Exclusion:
    """Rows for which ``condition`` is true leave; null counts as false."""

    label: str
    condition: Column
    reason: str


def code_in(column: str, codes: list) -> Column:
    return F.coalesce(F.col(column).isin(codes), F.lit(False))


def exclude_codes(df: DataFrame, column: str, codes: DataFrame | list) -> DataFrame:
    """Drop rows whose code is listed; a null code stays."""
    if isinstance(codes, DataFrame):
        return df.join(bounded(codes.select(F.col(codes.columns[0]).alias(column)).distinct()), column, "left_anti")
    return df.where(~code_in(column, codes))


def eligible(df: DataFrame, exclusions: list[Exclusion]) -> DataFrame:
    return reduce(lambda d, e: d.where(~F.coalesce(e.condition, F.lit(False))), exclusions, df)


def first_per_entity(df: DataFrame, entity: str, order: str, tie: str | None = None) -> DataFrame:
    """The row with the smallest order key per entity; ``tie`` (say, the row id) decides among equal keys.

    Planned as a group limit before and after the shuffle, so an entity with
    very many rows sends one row per input task.
    """
    w = Window.partitionBy(entity).orderBy(order, *([tie] if tie else []))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def binary_outcome(column: str, positive: str) -> Column:
    return F.coalesce(F.col(column) == positive, F.lit(False)).cast("int")


def derive_cohort(
    df: DataFrame, exclusions: list[Exclusion], entity: str, order: str, outcome: Column, target: str = "target"
) -> DataFrame:
    """Exclusions first, then the first record per entity, then the outcome."""
    return first_per_entity(eligible(df, exclusions), entity, order).withColumn(target, outcome)


def participant_flow(
    df: DataFrame, exclusions: list[Exclusion], entity: str, order: str, outcome: Column
) -> DataFrame:
    """step_no, step, n, excluded, reason after every step, in one scan.

    Each row is tagged with the first exclusion that removes it. Surviving rows
    are folded per entity with a partial aggregate, removed ones per tag.
    """
    tag = F.lit(None).cast("int")
    for i, e in reversed(list(enumerate(exclusions))):
        tag = F.when(F.coalesce(e.condition, F.lit(False)), i).otherwise(tag)
    tagged = df.select(tag.alias("_tag"), F.col(entity).alias("_e"), F.col(order).alias("_o"), outcome.alias("_y"))
    folded = (
        tagged.withColumn("_e", F.when(F.col("_tag").isNull(), F.col("_e")))
        .groupBy("_tag", "_e")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by("_y", "_o").alias("_y"))
    )
    kept = F.col("_tag").isNull()
    totals = folded.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw"),
        F.count(F.when(kept, 1)).alias("entities"),
        F.coalesce(F.sum(F.when(kept, F.col("_n"))), F.lit(0)).alias("survivors"),
        F.coalesce(F.sum(F.when(kept, F.col("_y"))), F.lit(0)).cast("bigint").alias("events"),
        *[
            F.coalesce(F.sum(F.when(F.col("_tag") == i, F.col("_n"))), F.lit(0)).alias(f"ex{i}")
            for i in range(len(exclusions))
        ],
    )

    def step(no, label, n, excluded, reason):
        return F.struct(
            F.lit(no).alias("step_no"),
            F.lit(label).alias("step"),
            n.alias("n"),
            excluded.alias("excluded"),
            reason.alias("reason"),
        )

    left = F.col("raw")
    rows = [step(0, "Raw records", left, F.lit(0).cast("bigint"), F.lit("-"))]
    for i, e in enumerate(exclusions):
        left = left - F.col(f"ex{i}")
        rows.append(step(i + 1, e.label, left, F.col(f"ex{i}"), F.lit(e.reason)))
    k = len(exclusions)
    rows.append(
        step(
            k + 1,
            "After retaining the first record per entity",
            F.col("entities"),
            F.col("survivors") - F.col("entities"),
            F.lit("repeat records removed"),
        )
    )
    rows.append(
        step(
            k + 2,
            "Final cohort",
            F.col("entities"),
            F.lit(0).cast("bigint"),
            F.concat(F.col("events").cast("string"), F.lit(" events")),
        )
    )
    return totals.select(F.inline(F.array(*rows)))


def cohort_gates(
    cohort: DataFrame, target: str, label: str, n_range: tuple[int, int], prevalence_range: tuple[float, float]
) -> DataFrame:
    """Size, prevalence and outcome-partition gates from one aggregate."""
    stats = cohort.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(target).alias("prevalence"),
        F.count(F.when(F.col(label).isNotNull(), 1)).alias("labelled"),
    )
    n, prev = F.col("n"), F.col("prevalence")
    return evaluate_gates(
        stats,
        [
            Gate("cohort_size", n.between(*n_range), F.concat(F.lit("n = "), n)),
            Gate("outcome_prevalence", prev.between(*prevalence_range), F.format_string("prevalence = %.6f", prev)),
            Gate("outcome_partition", F.col("labelled") == n, F.concat(F.lit("labelled = "), F.col("labelled"))),
        ],
    )


def complete_cases(df: DataFrame, columns: list[str], unknown: str = "Unknown") -> DataFrame:
    """Rows in which none of the columns holds the unknown level."""
    return reduce(lambda d, c: d.where(~F.col(c).eqNullSafe(unknown)), columns, df)
