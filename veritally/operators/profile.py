"""Table profiling: raw audit, variable dictionary, baseline table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.bounded import bounded
from veritally.operators.features import long_levels, long_numbers, numeric_columns
from veritally.operators.quantiles import exact_quantiles


def raw_audit(df: DataFrame, tokens: list[str], top: int = 5) -> DataFrame:
    """Per column: dtype, n_unique, n_missing, pct_missing, top values.

    All columns share one shuffle of per-value counts; the top values are cut
    before the counts meet again, so a unique column stays spread out.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = long_levels(df, df.columns).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("_rows"),
        F.count("level").alias("n_unique"),
        F.sum(F.when(F.col("level").isNull() | F.col("level").isin(tokens), F.col("n")).otherwise(0)).alias("n_missing"),
    )
    shown = counts.withColumn("level", F.coalesce("level", F.lit("nan")))
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "level")
    best = (
        shown.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= top)
        .groupBy("variable")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", F.concat_ws("=", "level", "n").alias("t")))).alias("_top"))
    )
    dtype = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return totals.join(best, "variable").select(
        F.col("variable").alias("column"),
        F.try_element_at(dtype, F.col("variable")).alias("dtype"),
        "n_unique",
        "n_missing",
        F.round(100 * F.col("n_missing") / F.col("_rows"), 2).alias("pct_missing"),
        F.array_join(F.transform("_top", lambda x: x["t"]), "; ").alias("top_values"),
    )


def count_gate_stats(df: DataFrame, entity: str, approximate: bool = False) -> DataFrame:
    """n_rows and n_entities."""
    distinct = F.approx_count_distinct(entity, 0.01) if approximate else F.count_distinct(F.col(entity))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_entities"))


def variable_dictionary(df: DataFrame, columns: list[str] | None = None, levels_shown: int = 12) -> DataFrame:
    """variable, type, n_levels, levels, missing_pct, q25, median, q75, mode, summary."""
    columns = columns or df.columns
    numeric = [c for c in numeric_columns(df) if c in columns]
    other = [c for c in columns if c not in numeric]
    parts = []
    if numeric:
        n_rows = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in numeric]
        )
        missing = n_rows.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("variable"),
                            F.round(100 * F.col(f"`{c}`") / F.col("n"), 3).alias("missing_pct"),
                        )
                        for c in numeric
                    ]
                )
            )
        )
        q = exact_quantiles(long_numbers(df, numeric), "value", [0.25, 0.5, 0.75], keys=["variable"])
        parts.append(
            missing.join(q, "variable", "left").select(
                "variable",
                F.lit("continuous").alias("type"),
                F.lit(None).cast("bigint").alias("n_levels"),
                F.lit(None).cast("string").alias("levels"),
                "missing_pct",
                F.col("q")[0].alias("q25"),
                F.col("q")[1].alias("median"),
                F.col("q")[2].alias("q75"),
                F.lit(None).cast("string").alias("mode"),
                F.format_string("median %.1f [IQR %.1f-%.1f]", F.col("q")[1], F.col("q")[0], F.col("q")[2]).alias("summary"),
            )
        )
    if other:
        counts = long_levels(df, other).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
        known = counts.where(F.col("level").isNotNull())
        totals = counts.groupBy("variable").agg(
            F.count("level").alias("n_levels"),
            F.round(
                100 * F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 3
            ).alias("missing_pct"),
            F.max(F.when(F.col("level").isNotNull(), F.col("n"))).alias("_peak"),
        )
        peaks = bounded(totals.select("variable", "_peak"))
        mode = known.join(peaks, "variable").where(F.col("n") == F.col("_peak")).groupBy("variable").agg(
            F.min("level").alias("mode")
        )
        w = Window.partitionBy("variable").orderBy("level")
        first = (
            known.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= levels_shown)
            .groupBy("variable")
            .agg(F.array_join(F.array_sort(F.collect_list("level")), "; ").alias("levels"))
        )
        none = F.lit(None).cast("double")
        parts.append(
            totals.join(mode, "variable", "left").join(first, "variable", "left").select(
                "variable",
                F.lit("categorical").alias("type"),
                "n_levels",
                "levels",
                "missing_pct",
                none.alias("q25"),
                none.alias("median"),
                none.alias("q75"),
                "mode",
                F.concat(F.lit("mode "), F.coalesce("mode", F.lit("-"))).alias("summary"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def baseline_table(
    df: DataFrame, target: str, continuous: list[str], categorical: list[str], max_levels: int = 8
) -> DataFrame:
    """Characteristics overall and by outcome, with standardised mean differences.

    Continuous variables give mean and SD, the most frequent ``max_levels``
    levels of categorical ones give count and share. ``n_*`` are row counts for
    N and for levels, ``mean_*`` holds the mean or the share.
    """
    y = F.col(target).cast("int")
    none = F.lit(None).cast("double")
    no_count = F.lit(None).cast("bigint")
    size = df.agg(
        F.count(F.lit(1)).alias("n_all"), F.sum((1 - y).cast("bigint")).alias("n_0"), F.sum(y.cast("bigint")).alias("n_1")
    )
    names = ["variable", "level", "n_all", "n_0", "n_1", "mean_all", "sd_all", "mean_0", "sd_0", "mean_1", "sd_1", "smd"]
    out = size.select(
        F.lit("N").alias("variable"),
        F.lit("").alias("level"),
        "n_all",
        "n_0",
        "n_1",
        *[none.alias(c) for c in names[5:]],
    )
    if continuous:
        value, v0, v1 = F.col("value"), F.when(F.col("_y") == 0, F.col("value")), F.when(F.col("_y") == 1, F.col("value"))
        stats = (
            long_numbers(df.withColumn("_y", y), continuous, ["_y"])
            .groupBy("variable")
            .agg(
                F.avg(value).alias("mean_all"),
                F.stddev_samp(value).alias("sd_all"),
                F.avg(v0).alias("mean_0"),
                F.stddev_samp(v0).alias("sd_0"),
                F.avg(v1).alias("mean_1"),
                F.stddev_samp(v1).alias("sd_1"),
            )
        )
        pooled = F.sqrt((F.col("sd_1") ** 2 + F.col("sd_0") ** 2) / 2)
        out = out.unionByName(
            stats.select(
                "variable",
                F.lit("mean (SD)").alias("level"),
                *[no_count.alias(c) for c in names[2:5]],
                *names[5:11],
                F.when(pooled > 0, (F.col("mean_1") - F.col("mean_0")) / pooled).alias("smd"),
            )
        )
    if categorical:
        counts = (
            long_levels(df.withColumn("_y", y), categorical, ["_y"])
            .where(F.col("level").isNotNull())
            .groupBy("variable", "level")
            .agg(
                F.count(F.lit(1)).alias("n_all"),
                F.sum((1 - F.col("_y")).cast("bigint")).alias("n_0"),
                F.sum(F.col("_y").cast("bigint")).alias("n_1"),
            )
        )
        w = Window.partitionBy("variable").orderBy(F.desc("n_all"), "level")
        shown = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_levels)
        row = size.first()
        p1, p0 = F.try_divide(F.col("n_1"), F.lit(row["n_1"])), F.try_divide(F.col("n_0"), F.lit(row["n_0"]))
        spread = F.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2)
        out = out.unionByName(
            shown.select(
                "variable",
                "level",
                "n_all",
                "n_0",
                "n_1",
                (F.col("n_all") / F.lit(row["n_all"])).alias("mean_all"),
                none.alias("sd_all"),
                p0.alias("mean_0"),
                none.alias("sd_0"),
                p1.alias("mean_1"),
                none.alias("sd_1"),
                F.when(spread > 0, (p1 - p0) / spread).alias("smd"),
            )
        )
    return out


def formatted_baseline(table: DataFrame) -> DataFrame:
    """The baseline table as printed text: ``12.30 (4.50)`` or ``1,234 (56.7%)``."""

    def cell(group: str):
        n, mean, sd = F.col(f"n_{group}"), F.col(f"mean_{group}"), F.col(f"sd_{group}")
        return (
            F.when(F.col("variable") == "N", F.format_number(n, 0))
            .when(n.isNull(), F.format_string("%.2f (%.2f)", mean, sd))
            .otherwise(F.concat(F.format_number(n, 0), F.format_string(" (%.1f%%)", 100 * mean)))
        )

    return table.select(
        "variable",
        "level",
        cell("all").alias("overall"),
        cell("0").alias("outcome_0"),
        cell("1").alias("outcome_1"),
        F.when(F.col("smd").isNull(), "").otherwise(F.format_string("%.3f", F.col("smd"))).alias("smd"),
    )
