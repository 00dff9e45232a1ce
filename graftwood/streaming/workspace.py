"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}
_marked: set[str] = set()


def located(path: str) -> str:
    """An absolute path, or the URL of a shared file system as it is."""
    return path if "://" in path else os.path.abspath(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as the JVM sees them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where it is unset, a temporary folder, but only if driver and executors are one machine."""
    configured = spark.conf.get(_CHECKPOINT, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{_CHECKPOINT} isn't set: intermediate tables need a folder that the driver and all executors of {master} share")
    if "dir" not in _own:
        held = tempfile.TemporaryDirectory(prefix="graftwood-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        _own["dir"] = f"file://{held.name}"
    return _own["dir"]


def application_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/graftwood-{spark.sparkContext.applicationId}"
    if path not in _marked:
        fs, at = hadoop(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(path)
    return path


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage, survives the loss of any executor and keeps later branches
    from computing the same rows twice.
    """
    spark = df.sparkSession
    path = f"{folder or application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_by_part_of_keys(spark: SparkSession) -> Iterator[None]:
    """Tables that are dealt alike by some of the columns that they are joined on stay where they are in what is executed inside; the setting is put back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def bounded_batches(spark: SparkSession, limit: int = 1 << 22) -> Iterator[None]:
    """What is executed inside hands Python about ``limit`` bytes at a time, or less where the session says so; the setting is put back.

    Executors hold a batch several times: as vectors, as the stream of them, and in Python.
    """
    before = spark.conf.get(_BYTES)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(_BYTES, str(min(limit, size) if size > 0 else limit))
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, on any file system that Spark knows; a local path is a file of the driver."""
    if "://" not in path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    fs, at = hadoop(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
