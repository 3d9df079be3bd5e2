"""Direction models on a feature frame, trained by Spark's own learners on the older part of each series."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

# The model types and their default settings.
MODEL_TYPES = {
    "random_forest": lambda: RandomForestClassifier(numTrees=10, maxDepth=4, seed=42),
    "gradient_boosting": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=42),
    "logistic_regression": lambda: LogisticRegression(maxIter=20, regParam=0.01),
    "svm": lambda: LinearSVC(maxIter=20, regParam=0.01),
}


@contextmanager
def read_in(spark: SparkSession, tasks: int | None) -> Iterator[None]:
    """Files that are read inside are cut into ``tasks`` pieces at least; as the session has it where that is None.

    The learners keep what they read of a piece as objects of many times its size, and read
    that again in each pass, so the pieces bound what a task holds and reads.
    """
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if tasks is not None:
        spark.conf.set(key, str(max(tasks, int(before or 0))))
    try:
        yield
    finally:
        if tasks is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fit(train: DataFrame, features: list[str], kind: str, label: str = "label"):
    """(scaler, model) of a model type; an unknown type raises."""
    if kind not in MODEL_TYPES:
        raise ValueError(f"unknown model type {kind}")
    rows = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(train)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows)
    learner = MODEL_TYPES[kind]().setLabelCol(label).setFeaturesCol("features")
    return scaler, learner.fit(scaler.transform(rows).select("features", label))


def predict(frame: DataFrame, features: list[str], fitted) -> DataFrame:
    """``frame`` with the predicted class; rows with a missing feature are left out."""
    scaler, model = fitted
    rows = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(frame)
    return model.transform(scaler.transform(rows)).select(*frame.columns, F.col("prediction").alias("predicted"))


def holdout(train: DataFrame, test: DataFrame, features: list[str], kinds=tuple(MODEL_TYPES)) -> DataFrame:
    """Rows, share of rises and accuracy of each model type on the newer part."""
    out = None
    for kind in kinds:
        p = predict(test, features, fit(train, features, kind))
        part = p.agg(
            F.count("*").alias("n"), F.avg("label").alias("rises"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy")
        ).select(F.lit(kind).alias("model_type"), "n", "rises", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out
