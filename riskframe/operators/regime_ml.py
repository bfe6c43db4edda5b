"""Supervised regime classifiers, feature selection and hybrids on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("random_forest", "gradient_boosting")


def fit_classifier(df: DataFrame, features: Sequence[str], label: str = "regime", method: str = "random_forest", trees: int = 100,
                   depth: int = 10, seed: int = 42) -> PipelineModel:
    """Assemble, standardise and fit a forest or boosted trees (one against rest beyond two classes)."""
    if method == "random_forest":
        last = RandomForestClassifier(labelCol=label, featuresCol="_z", numTrees=trees, maxDepth=depth, seed=seed)
    elif method == "gradient_boosting":
        last = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed), labelCol=label, featuresCol="_z")
    else:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"),
              StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True), last]
    return Pipeline(stages=stages).fit(df)


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted`` and, for forests, ``probs``."""
    out = model.transform(df).withColumn("predicted", F.col("prediction").cast("int"))
    if "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
    return out.drop("_x", "_z", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def select_univariate(df: DataFrame, features: Sequence[str], n: int, label: str = "regime") -> list[str]:
    """Names of the ``n`` features with the strongest one-way F test."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)
    chooser = UnivariateFeatureSelector(featuresCol="_x", labelCol=label, outputCol="_s", selectionMode="numTopFeatures")
    chooser = chooser.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(n)
    return [features[i] for i in sorted(chooser.fit(rows).selectedFeatures)]


def select_important(df: DataFrame, features: Sequence[str], n: int, label: str = "regime", trees: int = 30) -> list[str]:
    """Names of the ``n`` features a forest uses most."""
    model = fit_classifier(df, features, label, trees=trees)
    values = model.stages[-1].featureImportances.toArray()
    return [features[i] for i in sorted(sorted(range(len(features)), key=lambda i: (-values[i], i))[:n])]


def eliminate(df: DataFrame, features: Sequence[str], n: int, label: str = "regime", trees: int = 20) -> list[str]:
    """Drop the least important feature and refit until ``n`` are left."""
    left = list(features)
    while len(left) > n:
        left = select_important(df, left, len(left) - 1, label, trees)
    return left


def hybrid_fit(df: DataFrame, detector, features: Sequence[str], label: str = "regime", **kwargs) -> PipelineModel:
    """Train a classifier on the labels a fitted hidden Markov model decodes."""
    return fit_classifier(detector.predict(df), features, label, **kwargs)


def hybrid_probabilities(df: DataFrame, detector, model: PipelineModel, keys: Sequence[str], ts: str = "ts", share: float = 0.6) -> DataFrame:
    """share * hidden Markov probabilities + (1 - share) * classifier probabilities, and the likeliest state."""
    hmm = detector.predict_proba(df).withColumnRenamed("probs", "_h")
    ml = classify(model, df).select(*keys, ts, F.col("probs").alias("_m"))
    both = hmm.join(ml, [*keys, ts])
    blend = F.zip_with("_h", "_m", lambda h, m: share * h + (1 - share) * m)
    return both.withColumn("probs", blend).withColumn("regime", (F.array_position("probs", F.array_max("probs")) - 1).cast("int")).drop("_h", "_m")
