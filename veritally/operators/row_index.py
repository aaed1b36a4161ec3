"""Block X: a hash-ordered row number per stratum without one task per stratum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.hashing import HASH_BITS, key_hash
from veritally.operators.bounded import bounded, shuffle_partitions


def stratified_index(
    df: DataFrame,
    strata: list[str],
    row_id: str,
    seed: int,
    purpose: str,
    hash_on: list[str] | None = None,
    index: str = "idx",
    size: str = "stratum_n",
    bucket_bits: int | None = None,
) -> DataFrame:
    """Add each row's position in its stratum, in (hash, id) order, and the stratum size.

    The top bits of the hash cut a stratum into even buckets which are numbered
    in parallel; a running total of the bucket sizes shifts them. The result
    equals ``row_number() over (partition by strata order by hash, id)``.
    """
    if bucket_bits is None:
        bucket_bits = min(14, max(4, math.ceil(math.log2(4 * shuffle_partitions(df)))))
    hashed = df.withColumn("_h", key_hash(seed, purpose, *(hash_on or [row_id]))).withColumn(
        "_bucket", F.shiftright("_h", HASH_BITS - bucket_bits)
    )
    sizes = hashed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias(size),
    )
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_h", row_id)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(bounded(offsets), [*strata, "_bucket"])
        .withColumn(index, F.col("_r") + F.col("_offset"))
        .drop("_h", "_bucket", "_r", "_offset")
    )
