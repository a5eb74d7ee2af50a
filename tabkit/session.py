"""Where intermediate tables go, and how long they stay."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Paths handed out, the innermost open scope last.
_SCOPES: list[list[str]] = []


@cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="tabkit-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this process gets a temporary folder
    of its own without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    path = f"{base.rstrip('/')}/tabkit-{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lineage ends there, lost executors cost nothing that was finished, and the files
    carry a size by which Catalyst decides on broadcasting. ``by`` names a column of
    few values, each of which gets a folder that filters read alone.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths handed out inside the block."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()


def delete_staged(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        delete_path(spark, paths.pop())


def forget_finished(spark: SparkSession) -> None:
    """Let go of plans of finished jobs. Spark frees their shuffle files and broadcasts on
    all executors only once the driver's JVM has collected its garbage, which a loop of
    small jobs may put off until the heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _located(spark: SparkSession, path: str):
    """A path of any file system that Spark knows, and that file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    target, system = _located(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _located(spark, path)
    return system.exists(target)


def make_mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    target, system = _located(spark, path)
    system.create(target).close()


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what was staged inside the block when it ends.

    Results read staged tables, so write or collect them inside it. Without such a block
    staged tables stay, by the policy of that folder.
    """
    with collecting() as paths:
        try:
            yield
        finally:
            delete_staged(spark, paths)


def private_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session on the same cluster with the settings of ``spark`` and these, which
    later changes to ``spark`` do not reach."""
    private = spark.newSession()
    for row in spark.sql("SET").collect():
        if private.conf.isModifiable(row["key"]):
            private.conf.set(row["key"], row["value"])
    for key, value in settings.items():
        private.conf.set(key, value)
    return private
