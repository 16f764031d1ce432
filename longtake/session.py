"""Session helpers: settings the library needs, and where lineage may be cut."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# What a cluster session should set as well. The first lets one hot key of a join be split even
# where that costs another shuffle; two are Spark's defaults, stated because they matter here.
RECOMMENDED = {
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, name: str = "longtake", **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a session on one machine may name none; it gets a temporary folder. Elsewhere a folder of
    this machine would be out of the executors' reach, so that is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers import it by name; without this they find it only where it is installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


BATCH_BYTES = 4 << 20  # of rows with payloads that are sent to a Python worker at once
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers are bounded in bytes: ten thousand long texts would be held many times over."""
    known = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < known <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_TIDIED: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; dropped when its Python process ends."""
    application = spark.sparkContext.applicationId
    if application not in _TIDIED:
        _TIDIED.add(application)
        atexit.register(_release_at_end, spark)
    return f"{shared_folder(spark)}/longtake-{application}"


def _release_at_end(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        with contextlib.suppress(Exception):  # the JVM may have gone first
            release(spark)


def release(spark: SparkSession) -> None:
    """Delete the tables this application wrote between its steps."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame) -> str:
    """Write ``df`` to a new folder in the shared folder; returns its path."""
    path = f"{work_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where a result feeds several branches: it cuts the lineage, survives the loss of
    executors, and its file sizes let Spark decide what is small enough to broadcast.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))
