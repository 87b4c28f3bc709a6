"""Plain file sources and sinks: CSV, Parquet, listings and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed schema of the match file: column order counts
MATCH_SCHEMA = "index string, mz double, rt double, intensity double, title string, score1 double, score2 double"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, glob: str | None = None) -> DataFrame:
    """CSV with a header and a declared schema; ``glob`` filters file names."""
    reader = spark.read.option("header", True).option("enforceSchema", True).schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MATCH_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, by: str = "file") -> None:
    """Keep a stage as Parquet, one folder per run file.

    Rows spread over all tasks, so a large file is written by many of them.
    """
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Files of a folder whose name matches, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), "length")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")
