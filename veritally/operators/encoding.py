"""Encoding of the analysis matrix for MLlib: one-hot, scaling, feature names."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.operators.split import ColumnRoles


@dataclass
class Encoding:
    """A fitted encoder and what each slot of its ``features`` vector means."""

    model: PipelineModel
    names: list[str]
    parents: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_encoding(train: DataFrame, roles: ColumnRoles, scale: bool, drop_first: bool) -> Encoding:
    """Fit on training rows only; refit it for every fold.

    Levels unseen in training become an all-zero block. ``drop_first`` leaves out
    the alphabetically first level of each categorical column. Scaling divides by
    the population standard deviation.
    """
    stages, blocks = [], []
    names: list[str] = []
    parents: list[str] = []
    data = train
    if roles.continuous:
        assemble = VectorAssembler(inputCols=roles.continuous, outputCol="_num")
        stages.append(assemble)
        block = "_num"
        if scale:
            data = assemble.transform(data)
            scaler = StandardScaler(withMean=True, withStd=True, inputCol="_num", outputCol="_std").fit(data)
            n = train.count()
            ratio = math.sqrt(n / (n - 1)) if n > 1 else 1.0
            widen = ElementwiseProduct(
                scalingVec=Vectors.dense([ratio] * len(roles.continuous)), inputCol="_std", outputCol="_num_scaled"
            )
            stages += [scaler, widen]
            block = "_num_scaled"
        blocks.append(block)
        names += [f"num__{c}" for c in roles.continuous]
        parents += roles.continuous
    if roles.categorical:
        indexed = [f"_ix_{c}" for c in roles.categorical]
        hot = [f"_hot_{c}" for c in roles.categorical]
        indexer = StringIndexer(
            inputCols=roles.categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ).fit(train)
        encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True).fit(indexer.transform(train.limit(1)))
        gather = VectorAssembler(inputCols=hot, outputCol="_cat")
        stages += [indexer, encoder, gather]
        block, kept, slot = "_cat", [], 0
        for column, labels in zip(roles.categorical, indexer.labelsArray):
            for i, label in enumerate(labels):
                if not (drop_first and i == 0):
                    kept.append(slot)
                    names.append(f"cat__{column}_{label}")
                    parents.append(column)
                slot += 1
        if len(kept) < slot and kept:
            stages.append(VectorSlicer(inputCol="_cat", outputCol="_cat_kept", indices=kept))
            block = "_cat_kept"
        if kept:
            blocks.append(block)
    stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    return Encoding(PipelineModel(stages), names, parents)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_num", "_std", "_ix_", "_hot_", "_cat"))])


def parent_features(encoded: DataFrame, originals: list[str], name: str = "encoded_feature") -> DataFrame:
    """Add ``feature``: the longest source column that the encoded name starts with."""
    bare = F.regexp_replace(F.col(name), r"^.*?__", "")
    known = F.array(*[F.lit(c) for c in originals])
    fits = F.filter(known, lambda c: (bare == c) | bare.startswith(F.concat(c, F.lit("_"))))
    longest = F.array_max(F.transform(fits, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    return encoded.withColumn("feature", F.coalesce(longest, bare))
