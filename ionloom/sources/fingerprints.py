"""Fingerprint CSV files: a mass column followed by one intensity column per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.sources.files import list_files, stem

# fixed values of the naming scheme
TARGET_SUFFIX = "_GT"
PREDICTION_MARK = "prediction"
WEIGHT_SUFFIX = "_weights"


def paired_stems(names: DataFrame) -> DataFrame:
    """Stems that have a target file: ``stem`` of X.csv where X_GT.csv exists."""
    inputs = names.filter(~F.col("stem").contains(TARGET_SUFFIX) & ~F.col("stem").contains(PREDICTION_MARK))
    targets = names.filter(F.col("stem").endswith(TARGET_SUFFIX)).select(
        F.regexp_replace("stem", f"{TARGET_SUFFIX}$", "").alias("stem")
    )
    return inputs.join(targets, "stem", "left_semi")


def split_by_weights(names: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Input stems with and without a weight file (``stem`` of X_weights)."""
    inputs = names.filter(~F.col("stem").contains(TARGET_SUFFIX))
    known = weights.select(F.regexp_replace("stem", f"{WEIGHT_SUFFIX}$", "").alias("stem")).distinct()
    return inputs.join(known, "stem", "left_semi"), inputs.join(known, "stem", "left_anti")


def csv_stems(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, "*.csv").select(stem(F.col("path")).alias("stem"), "path")


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Long fingerprints of files of one layout: stem, mz, label, value."""
    wide = spark.read.option("header", True).csv(path).withColumn("stem", stem(F.col("_metadata.file_path")))
    mz, *labels = [c for c in wide.columns if c != "stem"]
    numeric = wide.select("stem", F.col(f"`{mz}`").cast("double").alias("mz"), *[F.col(f"`{c}`").cast("double").alias(c) for c in labels])
    return numeric.unpivot(["stem", "mz"], labels, "label", "value")
