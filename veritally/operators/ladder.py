"""Block L: the score ladder.

One row per distinct score (and key), with the positives and negatives at that
score and below it. Almost every metric of a scored table is one aggregation
over its ladder, so equal scores are folded before anything is sorted and a
score that holds a third of all rows is a single ladder row.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.bounded import bounded, stored

MAX_BUCKETS = 65_536  # edges the driver may hold; with the rows below, tables of 65 billion distinct scores
BUCKET_ROWS = 1_000_000


def balanced_edges(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Inner edges that cut the column into about even parts, from a bounded sketch.

    Uneven parts would only cost time: results never depend on the edges.
    """
    if buckets <= 1:
        return []
    grid = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, grid, max(100, 10 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def add_bucket(df: DataFrame, column: str, edges: list[float], out: str) -> DataFrame:
    """Interval number of ``column`` between shared edges, by binary search in the JVM."""
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *edges, math.inf]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)


def score_cells(
    scored: DataFrame, keys: list[str], score: str = "p", label: str = "y", weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per (keys, score)."""
    w = F.lit(1) if weight is None else weight
    y = F.col(label).cast("bigint")
    return scored.groupBy(*keys, F.col(score).cast("double").alias("p")).agg(
        F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg")
    )


def score_ladder(
    scored: DataFrame,
    keys: list[str],
    score: str = "p",
    label: str = "y",
    weight: Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Columns: keys, p, pos, neg, pos_below, neg_below, pos_total, neg_total.

    Running sums are taken inside score buckets of about ``bucket_rows`` rows and
    shifted by the bucket totals, so no key is ever sorted in one task.
    """
    cells = stored(score_cells(scored, keys, score, label, weight))
    buckets = min(MAX_BUCKETS, math.ceil(cells.count() / bucket_rows))
    return running_totals(cells, keys, balanced_edges(cells, "p", buckets))


def running_totals(cells: DataFrame, keys: list[str], edges: list[float]) -> DataFrame:
    if not edges:
        below = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        return cells.select(
            *keys,
            "p",
            "pos",
            "neg",
            F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("pos_below"),
            F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("neg_below"),
            F.sum("pos").over(whole).alias("pos_total"),
            F.sum("neg").over(whole).alias("neg_total"),
        )
    cells = add_bucket(cells, "p", edges, "_bucket")
    sums = cells.groupBy(*keys, "_bucket").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_pos_off"),
        F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_neg_off"),
        F.sum("_pos").over(whole).alias("pos_total"),
        F.sum("_neg").over(whole).alias("neg_total"),
    )
    below = Window.partitionBy(*keys, "_bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.select(
        "*",
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("_pos_in"),
        F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("_neg_in"),
    )
    return inside.join(bounded(offsets), [*keys, "_bucket"]).select(
        *keys,
        "p",
        "pos",
        "neg",
        (F.col("_pos_in") + F.col("_pos_off")).alias("pos_below"),
        (F.col("_neg_in") + F.col("_neg_off")).alias("neg_below"),
        "pos_total",
        "neg_total",
    )


def ladder_quantiles(ladder: DataFrame, keys: list[str], probs: list[float], out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles of the score: keys and one array column.

    A quantile needs the scores at two sorted positions; each is found in the
    one ladder row whose rank interval holds it.
    """
    n, below = F.col("pos_total") + F.col("neg_total"), F.col("pos_below") + F.col("neg_below")
    upto = below + F.col("pos") + F.col("neg")
    aggs = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (n - 1)
        low, high = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((low >= below) & (low < upto), F.col("p"))).alias(f"_lo{i}"),
            F.max(F.when((high >= below) & (high < upto), F.col("p"))).alias(f"_hi{i}"),
            F.max(at - low).alias(f"_w{i}"),
        ]
    wide = ladder.groupBy(*keys).agg(*aggs)
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(probs))
    ]
    return wide.select(*keys, F.array(*values).alias(out))
