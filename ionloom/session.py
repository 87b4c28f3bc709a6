"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they may be applied to a session somebody else built.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split a shuffle partition that one hot key has blown up, even if that costs an exchange later
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    The functions that run there import it, and it need not be installed on them.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ionloom-py-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Prepare an existing session: adaptive execution and the package on the workers."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def get_session(app: str = "ionloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # checkpoints of dropped results are removed again
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only a
    session without one (tests, laptops) gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="ionloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return folder


def session_folder(spark: SparkSession, kind: str) -> str:
    """Name of a new folder below the checkpoint folder, which goes when the session ends."""
    folder = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(frame: DataFrame) -> DataFrame:
    """Cut lineage by a table in the checkpoint folder, which goes when the session ends.

    Unlike ``checkpoint()`` this also measures the rows: a checkpoint keeps the size its plan was
    estimated at, and estimates of joins multiply, so after a dozen rounds that join a result with
    itself the numbers have more digits than the planner can handle.
    """
    spark = frame.sparkSession
    folder = session_folder(spark, "rounds")
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
