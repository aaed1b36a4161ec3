"""Exact quantiles of plain columns, without gathering a column in one task."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.bounded import bounded, shuffle_partitions
from veritally.operators.ladder import MAX_BUCKETS, add_bucket, balanced_edges


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles: keys, n, q (array in the order of ``probs``).

    A sketch gives bucket edges, a count per bucket tells which buckets hold the
    wanted positions, and only the rows of those buckets are grouped and sorted.
    """
    keys = keys or []
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(16, 4 * shuffle_partitions(df)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = add_bucket(rows, "_v", balanced_edges(rows, "_v", buckets), "_bucket")

    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(
        *keys,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n"),
    )
    wanted = placed.select(
        *keys,
        "_bucket",
        "n",
        "_n",
        "_off",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), side.alias("side"), pos(F.lit(float(q)) * (F.col("n") - 1)).alias("at"))
                    for i, q in enumerate(probs)
                    for side, pos in ((F.lit(0), F.floor), (F.lit(1), F.ceil))
                ]
            )
        ).alias("w"),
    ).where((F.col("w.at") >= F.col("_off")) & (F.col("w.at") < F.col("_off") + F.col("_n")))
    wanted = bounded(
        wanted.select(*keys, "_bucket", "n", "w.i", "w.side", (F.col("w.at") - F.col("_off")).alias("_at"))
    )
    targets = wanted.select(*keys, "_bucket").distinct()
    cells = (
        rows.join(bounded(targets), [*keys, "_bucket"], "left_semi")
        .groupBy(*keys, "_bucket", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_end", F.sum("_c").over(upto))
    found = ranked.join(wanted, [*keys, "_bucket"]).where(
        (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))
    )
    aggs = [F.max("n").alias("n")]
    for i in range(len(probs)):
        for side in (0, 1):
            hit = (F.col("i") == i) & (F.col("side") == side)
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_q{i}_{side}"))
    wide = found.groupBy(*keys).agg(*aggs)
    values = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col(f"_q{i}_0"), F.col(f"_q{i}_1")
        values.append(low + (high - low) * (at - F.floor(at)))
    return wide.select(*keys, "n", F.array(*values).alias("q"))
