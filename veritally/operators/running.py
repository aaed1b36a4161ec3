"""Running totals and running maxima over long ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.bounded import bounded


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column | None,
    order: list,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and maxima per key group in ``order``.

    ``bucket`` must not decrease along the order. Windows run inside a bucket;
    what earlier buckets carry over is a small table joined back. Without a
    bucket a key group is one window: for groups of known small size only.
    """
    sums, maxes = sums or {}, maxes or {}
    if bucket is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(e).over(upto).alias(c) for c, e in sums.items()],
            *[F.max(e).over(upto).alias(c) for c, e in maxes.items()],
        )
    data = df.withColumn("_b", bucket)
    carried = data.groupBy(*keys, "_b").agg(
        *[F.sum(e).alias(f"_s_{c}") for c, e in sums.items()], *[F.max(e).alias(f"_m_{c}") for c, e in maxes.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
        *[F.max(f"_m_{c}").over(before).alias(f"_m_{c}") for c in maxes],
    )
    upto = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = data.select(
        "*",
        *[F.sum(e).over(upto).alias(c) for c, e in sums.items()],
        *[F.max(e).over(upto).alias(c) for c, e in maxes.items()],
    )
    joined = inside.join(bounded(carried), [*keys, "_b"])
    for c in sums:
        joined = joined.withColumn(c, F.col(c) + F.col(f"_s_{c}"))
    for c in maxes:
        joined = joined.withColumn(c, F.greatest(c, f"_m_{c}"))
    return joined.drop("_b", *[f"_s_{c}" for c in sums], *[f"_m_{c}" for c in maxes])
