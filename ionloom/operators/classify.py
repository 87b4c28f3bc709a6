"""Tree classifiers on wide cohort tables, over Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import checkpoint_dir

# fixed values of the cohort script
TREES, TOP_FEATURES = 100, 10
BOOST_ROUNDS, BOOST_STEP, BOOST_DEPTH, CUT = 210, 0.01, 5, 0.5
CHECKPOINT_ROUNDS = 10  # rounds after which boosting cuts its lineage
SEED = 123


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def random_forest(train: DataFrame, features: list[str], label: str = "label", depth: int = 5, trees: int = TREES):
    """Random forest of ``trees`` trees; returns the Spark ML model."""
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)
    return forest.fit(_assembled(train, features))


def feature_importance(df: DataFrame, model, features: list[str]) -> DataFrame:
    """Gini importance per feature (one row per model input)."""
    rows = [(name, float(weight)) for name, weight in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def boosted_trees(
    train: DataFrame, features: list[str], label: str = "label",
    rounds: int = BOOST_ROUNDS, step: float = BOOST_STEP, depth: int = BOOST_DEPTH,
):
    """Gradient-boosted trees with logistic loss; returns the Spark ML model.

    Trees grow level by level here, not leaf by leaf.
    """
    checkpoint_dir(train.sparkSession)  # without a folder nothing is checkpointed
    boost = GBTClassifier(
        labelCol=label, maxIter=rounds, stepSize=step, maxDepth=depth, seed=SEED, checkpointInterval=CHECKPOINT_ROUNDS
    )
    return boost.fit(_assembled(train, features))


def classify(df: DataFrame, model, features: list[str], cut: float = CUT) -> DataFrame:
    """Add the class-1 ``probability`` and the ``predicted`` class."""
    scored = model.transform(_assembled(df, features)).withColumn(
        "score", F.get(vector_to_array("probability"), F.lit(1))
    )
    predicted = F.when(F.col("score") > F.lit(cut), 1).otherwise(0)
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("predicted", predicted)
