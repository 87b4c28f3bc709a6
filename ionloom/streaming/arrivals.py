"""The batch job over run files, as a stream of arriving files.

A run's rows may lie in several files, and those may arrive in different
micro-batches. Each batch therefore names the runs it touches, and the job is
done again on all rows of these runs that have arrived so far; its result
replaces what was there for them. So the results equal those of one batch run
over the same files, however they arrive, and a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PEAK_SCHEMA = "file string, sid bigint, rt double, precursor_mz double, scan_no int, mz double, intensity double"


def annotate_arrivals(
    spark: SparkSession,
    folder: str,
    out: str,
    progress: str,
    job: Callable[[DataFrame], DataFrame],
    max_files: int = 64,
) -> StreamingQuery:
    """Run ``job`` on the runs of each batch of new Parquet files and stop when none is left.

    ``job`` keeps the column ``file``; ``out`` is partitioned by it. ``progress`` is the stream's checkpoint folder.
    """

    def handle(batch: DataFrame, number: int) -> None:
        touched = batch.select("file").distinct()
        rows = spark.read.schema(PEAK_SCHEMA).parquet(folder)
        whole = rows.join(touched.withColumnRenamed("file", "_run"), F.col("file").eqNullSafe(F.col("_run")), "left_semi")
        result = job(whole).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        result.partitionBy("file").parquet(out)

    arrivals = spark.readStream.schema(PEAK_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)
    return (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
