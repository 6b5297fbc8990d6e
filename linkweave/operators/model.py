"""Pair scorers: a fixed scorecard, boosted trees with grouped out-of-fold scores, and pluggable ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .decide import fold_of
from .groups import group_features, robust

#: Weights of the scorecard over native features.
SCORECARD = {"score": 4.0, "n_jacc": 2.0, "num_first_eq": 1.5, "a_words_jacc": 1.0}
INTERCEPT = -5.0


def scorecard(features: DataFrame, weights: dict[str, float] | None = None, intercept: float = INTERCEPT) -> DataFrame:
    """Add p of a logistic scorecard, rounded to 9 places so that ties are ties."""
    z = reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in (weights or SCORECARD).items()), F.lit(intercept))
    return features.withColumn("p", F.round(1 / (1 + F.exp(-z)), 9))


def trees(columns: list[str], rounds: int = 20, depth: int = 5, seed: int = 1) -> Pipeline:
    """Level-wise boosted trees over feature columns; nulls are kept as a value of their own."""
    join = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[join, GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.08 if rounds > 100 else 0.2, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=10, maxBins=127, seed=seed)])


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(features: DataFrame, columns: list[str], s1_number: str = "s1_id", **settings) -> DataFrame:
    """p of each row from the model that did not see its canonical record."""
    folded = features.withColumn("fold", fold_of(F.col(s1_number)))
    parts = []
    for k in (0, 1):
        model = trees(columns, **settings).fit(folded.where(F.col("fold") != k))
        parts.append(predict(model, folded.where(F.col("fold") == k)))
    return parts[0].unionByName(parts[1])


def stacked(features: DataFrame, columns: list[str], s1: DataFrame, q: DataFrame, **settings) -> DataFrame:
    """Second stage: out-of-fold scores, their group features without self-support, and out-of-fold scores again."""
    first = out_of_fold(features, columns, **settings)
    groups = robust(group_features(first, s1, q))
    more = [c for c in groups.columns if c not in ("q_id", "s1_id")]
    joined = first.drop("p", "fold").join(groups, ["q_id", "s1_id"])
    return out_of_fold(joined, columns + more, **settings)


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Features by gain, largest first."""
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def rescored(pairs: DataFrame, scorers: list[Callable[[pd.Series, pd.Series], object]]) -> DataFrame:
    """Add ce: the mean of pluggable scorers of two text columns, a and b."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(ce=sum(pd.Series(f(part.a, part.b), dtype=float).to_numpy() for f in scorers) / len(scorers))

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("ce", DoubleType())]))
