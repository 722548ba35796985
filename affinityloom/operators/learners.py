"""Supervised and unsupervised model families on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_family(train: DataFrame, features: Sequence[str], label: str, family: str, task: str, seed: int = 42,
               trees: int = 20, depth: int = 5, hidden: int = 16, rounds: int = 50) -> PipelineModel:
    """Random forest, boosted trees or a dense network over numeric columns."""
    common = {"featuresCol": "features", "labelCol": label, "seed": seed}
    if family == "random_forest":
        kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
        learner = kind(numTrees=trees, maxDepth=depth, **common)
    elif family == "boosted_trees":
        kind = GBTRegressor if task == "regression" else GBTClassifier
        learner = kind(maxIter=trees, maxDepth=depth, **common)
    elif family == "dense_network" and task == "classification":
        learner = MultilayerPerceptronClassifier(layers=[len(features), hidden, 2], maxIter=rounds, **common)
    else:
        raise ValueError(f"no {family} for {task}")
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[assembler, scaler, learner]).fit(train)


def embed_and_cluster(df: DataFrame, vector: str, dims: int = 8, clusters: int = 4, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """Standardise, project to principal components, cluster; rows with cluster, and metrics."""
    rows = df.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=dims, inputCol="scaled", outputCol="features"),
        KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster")]).fit(rows)
    placed = model.transform(rows)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(placed)
    explained = float(sum(model.stages[1].explainedVariance))
    return placed, {"silhouette": round(silhouette, 6), "explained": round(explained, 6), "clusters": clusters}


def reconstruction_error(df: DataFrame, record: str, vector: str, dims: int = 8) -> DataFrame:
    """Per-row root mean square error after projection to ``dims`` components and back.

    Uses the loss of squared length under an orthonormal projection, so nothing is multiplied back.
    """
    rows = df.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
                             PCA(k=dims, inputCol="scaled", outputCol="features")]).fit(rows)
    placed = model.transform(rows)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)
    lost = F.greatest(square("scaled") - square("features"), F.lit(0.0))
    return placed.select(record, F.round(F.sqrt(lost / F.size(vector)), 6).alias("error"))


def batch_inference(model: PipelineModel, ids: DataFrame, features: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Prediction per requested id; ids without usable features come back as error rows."""
    joined = ids.join(features.select(key, *columns, F.lit(True).alias("_known")), key, "left")
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull()
    good = model.transform(joined.filter(usable)).select(key, F.col("prediction").cast("double").alias("prediction"), F.lit("ok").alias("status"))
    bad = joined.filter(~usable).select(
        key, F.lit(None).cast("double").alias("prediction"),
        F.when(F.col("_known").isNull(), "missing_features").otherwise("incomplete_features").alias("status"))
    return good.unionByName(bad)
