"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ionloom.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# An Arrow batch holds at most so many rows; texts are long, so this also bounds a Python worker's memory.
ARROW_ROWS = 256


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(column, UPPER, LOWER)


def narrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Hand Python workers few rows at a time, since one row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; it goes when the session's JVM ends."""
    folder = f"{checkpoint_dir(spark)}/ionloom-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back."""
    spark = frame.sparkSession
    folder = shared_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes (a longer row is a run of its own)."""
    first = 0
    rows = len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def _fingerprint(frame: DataFrame) -> tuple:
    """Count and hash sum of a table without repeated rows."""
    return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, low: str = "a", high: str = "b", name: str = "components") -> DataFrame:
    """Connected components of an edge list as ``(node, root)``; ``root`` is the smallest node reached.

    Alternates large-star and small-star steps, so that rounds grow with the logarithm of a component's
    size. Each step is one aggregation by node; an edge table is kept between rounds, never a component.
    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    current = staged(
        edges.select(F.greatest(low, high).alias("node"), F.least(low, high).alias("root")).where("node > root").distinct(), name
    )
    before = _fingerprint(current)
    small = current
    while True:
        both = small.unionByName(small.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        large = (
            both.where("root > node")
            .join(least, "node")
            .select(F.col("root").alias("node"), F.col("m").alias("root"))
            .where("node > root")
            .distinct()
        )
        large = staged(large, name)
        # small star: a node and its smaller neighbours move to the smallest of them
        smallest = large.groupBy("node").agg(F.min("root").alias("m"))
        small = (
            large.join(smallest, "node")
            .select(F.col("root").alias("node"), F.col("m").alias("root"))
            .where("node > root")
            .unionByName(smallest.select("node", F.col("m").alias("root")))
            .distinct()
        )
        small = staged(small, name)
        now = _fingerprint(small)
        if now == before:
            return small
        before = now


def extended(schema: StructType, extra: str) -> StructType:
    """A schema with further fields, given as DDL, at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(extra).fields])
