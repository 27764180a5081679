"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORK_DIR_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOTS: dict[str, str] = {}
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def build_session(app: str = "codestrata", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the library is tuned for; cluster sizing stays with spark-submit."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even where that costs one more shuffle downstream.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Source files and documents vary from bytes to megabytes, so batches to Python are bounded by size.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    conf.update(settings)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder the session names.

    Only a local session without that setting gets a folder of its own, removed when it ends; on a cluster
    an unset folder is an error, because executors would not see each other's files. Inside `scratch` it is a part of that.
    """
    if _SCRATCH.get():
        return f"{_SCRATCH.get()}/{name}-{uuid.uuid4().hex}"
    root = spark.conf.get(WORK_DIR_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {WORK_DIR_SETTING} to a folder all executors share")
        session = spark.sparkContext.applicationId
        if session not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[session] = tempfile.mkdtemp(prefix="codestrata-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[session], ignore_errors=True)
        root = _LOCAL_ROOTS[session]
    return f"{root.rstrip('/')}/codestrata/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """What is staged inside goes at the end, for a job of many steps whose results are stored by then. Gives the folder."""
    path = work_dir(spark, name)
    outer = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP_SETTING, None)
    spark.conf.set(SHUFFLE_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_SETTING)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_SETTING, before)


def stage(df: DataFrame, name: str, *partition_by: str, codec: str | None = None, folder: str | None = None) -> DataFrame:
    """Write a result that several branches need to the shared folder, or that of an outer `scratch`, and read it back.

    Cuts the lineage, so the branches neither recompute it nor lose it with an executor.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else work_dir(spark, name)
    writer = df.write.mode("errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key over as many tasks as a shuffle has.

    For parsers and patterns, whose time goes by rows: scans are cut and shuffles joined by bytes, so a few compressed files of
    small texts would be hours of work in a task while other cores have none.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Mark a narrow side for broadcast after finding that it has at most `max_rows` rows and `max_bytes` as JSON.

    For a side that is cheap to compute twice; otherwise `stage` it first. A larger side is
    returned as it is and joins by shuffle, where adaptive execution splits hot keys.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    rows, taken = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= max_rows and taken <= max_bytes else df
