"""Session helpers: shared scratch space, checkpoints and broadcast guards."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Sides with a proven bound below this many rows may be broadcast by hint.
BROADCAST_ROWS = 50_000

_local_dir: str | None = None


def local_session(name: str = "gridweave", cpus: str = "8") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/gridweave-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    A written table survives executor loss and, unlike a checkpointed plan,
    carries no inferred constraints over, so loops do not slow down.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes in memory per byte of a written table of numbers: ids that follow each other pack to a fraction of what a driver holds to send them.
PACKED = 4
_FACTOR = "spark.sql.sources.fileCompressionFactor"


@contextmanager
def unpacked_sizes(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned meanwhile take written tables for ``PACKED`` times their files, unless the session says otherwise.

    Spark sends a side to all executors by its files' size, and a file of ten
    MB may hold some million rows, which the driver has to gather.
    """
    before = spark.conf.get(_FACTOR)
    if float(before) == 1.0:
        spark.conf.set(_FACTOR, str(float(PACKED)))
    try:
        yield
    finally:
        spark.conf.set(_FACTOR, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table after its last reader."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows and bytes of a batch that goes to a Python step: rows hold whole texts, and each buffer of a batch doubles as it grows.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Spark's own file server hands the archive out, so the executors need
    neither the repository nor a shared folder to run Python steps.  Batches of
    this session's Python steps are kept small, unless it was told otherwise.
    """
    for key, most, usual in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, None)):
        key = f"spark.sql.execution.arrow.{key}"
        if usual is None or spark.conf.get(key, usual) == usual:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "gridweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
