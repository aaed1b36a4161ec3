"""Model-based imputation of an unknown categorical level."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions.hashing import key_uniform


def impute_level(
    df: DataFrame,
    column: str,
    row_id: str,
    predictors: list[str],
    draws: int = 5,
    seed: int = 42,
    unknown: str = "Unknown",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """One copy of the rows per draw (column ``draw``), unknown levels drawn from a multinomial model.

    The level is the first whose cumulative predicted probability exceeds the
    row's uniform draw, so imputations do not depend on partitioning. ``fit_on`` are the rows to
    learn from, all rows if it is left out.
    """
    known = (df if fit_on is None else fit_on).where(~F.col(column).eqNullSafe(unknown) & F.col(column).isNotNull())
    indexer = StringIndexer(inputCol=column, outputCol="_level", stringOrderType="alphabetAsc").fit(known)
    assemble = VectorAssembler(inputCols=predictors, outputCol="_x")
    scaler = StandardScaler(withMean=True, inputCol="_x", outputCol="features").fit(assemble.transform(known))
    train = scaler.transform(assemble.transform(indexer.transform(known))).select("features", "_level")
    model = LogisticRegression(featuresCol="features", labelCol="_level", family="multinomial", maxIter=100).fit(train)
    rows = model.transform(scaler.transform(assemble.transform(df)))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = key_uniform(seed, "impute", "draw", row_id)
    upto = F.transform(
        F.sequence(F.lit(1), F.size("_p")), lambda i: F.aggregate(F.slice("_p", F.lit(1), i), F.lit(0.0), lambda a, x: a + x)
    )
    rows = rows.withColumn("_p", vector_to_array("probability")).withColumn("_u", u).withColumn("_upto", upto)
    labels = F.array(*[F.lit(v) for v in indexer.labels])
    pick = F.least(F.size(F.filter("_upto", lambda c: c <= F.col("_u"))), F.lit(len(indexer.labels) - 1))
    missing = F.col(column).isNull() | (F.col(column) == unknown)
    filled = F.when(missing, F.element_at(labels, pick + 1)).otherwise(F.col(column))
    return rows.withColumn(column, filled).select("draw", *df.columns)
