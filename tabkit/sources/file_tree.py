"""File trees: one record per file, and the first bytes of files.

Spark's own file sources skip empty files and names that begin with '.' or '_', and
hold the whole listing in the driver. A tree is therefore walked by tasks: each lists
some directories and hands unvisited ones on to the next round.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.lookups import HEAD_BYTES
from tabkit.session import stage

LISTING = (
    "path string, is_dir boolean, length bigint, created timestamp, modified timestamp, "
    "status string, note string"
)
COLUMNS = ["path", "is_dir", "length", "created", "modified", "status", "note"]
# Entries a task lists before it hands its remaining directories on.
WALK_ENTRIES = 20_000
BATCH_ROWS = 5_000
# Files whose first bytes are held at a time.
HEAD_ROWS = 500
TASK_FILES = 20_000


def _name(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace")


def _local_entries(folder: str):
    """Entries of a local directory, one at a time."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                if entry.is_dir():
                    if not entry.is_symlink():
                        yield entry.path, True, None, None, None, "ok", ""
                    continue
                info = entry.stat()
                yield entry.path, False, info.st_size, info.st_ctime_ns, info.st_mtime_ns, "ok", ""
            except OSError as error:
                yield entry.path, False, None, None, None, "failed", str(error)


def _filesystem(path: str):
    """``(file system, path in it)`` of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def file_system(path: str):
    """``(file system, path in it)`` of a local path or a URI."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if _is_local(path) else _filesystem(path)


def _remote_entries(folder: str):
    """Entries of a directory on HDFS or an object store; these keep no creation time."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    prefix = folder[: len(folder) - len(path)]
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.type == fs.FileType.Directory:
            yield prefix + info.path, True, None, None, None, "ok", ""
        else:
            yield prefix + info.path, False, info.size, None, info.mtime_ns, "ok", ""


def _is_local(path: str) -> bool:
    return "://" not in path


def _frame(rows: list) -> pd.DataFrame:
    # As objects: beside the nulls of directories numbers would become floats, which do
    # not hold nanoseconds.
    frame = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    frame["path"] = frame["path"].map(_name)
    frame["length"] = frame["length"].astype("Int64")
    for column in ("created", "modified"):
        moments = [None if ns is None else ns // 1000 for ns in frame[column]]
        frame[column] = pd.Series(np.array(moments, "datetime64[us]")).dt.tz_localize("UTC")
    return frame


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    listed, rows = 0, []
    for batch in batches:
        pending = list(batch["path"])
        while pending:
            folder = pending.pop()
            if listed >= WALK_ENTRIES:
                rows.append((folder, True, None, None, None, "ok", ""))
                continue
            try:
                for entry in _local_entries(folder) if _is_local(folder) else _remote_entries(folder):
                    listed += 1
                    if entry[1]:
                        pending.append(entry[0])
                        continue
                    rows.append(entry)
                    if len(rows) >= BATCH_ROWS:
                        yield _frame(rows)
                        rows = []
            except OSError as error:
                rows.append((folder, False, None, None, None, "failed", str(error)))
    if rows:
        yield _frame(rows)


def tree_root(spark: SparkSession, root: str) -> str:
    """A root as paths below it are listed: local without scheme, others with theirs."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    elif _is_local(root):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not default.startswith("file:"):
            root = default.rstrip("/") + root
    return root.rstrip("/") or "/"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One record per file below ``root``: ``(path, length, created, modified, status, note)``.

    Links to directories are not followed. What cannot be read is listed as failed.
    """
    root = tree_root(spark, root)
    pending = spark.createDataFrame([(root,)], "path string")
    width = spark.sparkContext.defaultParallelism
    rounds = []
    while True:
        found = stage(pending.mapInPandas(_walk, LISTING), "listing")
        rounds.append(found.filter("NOT is_dir"))
        # Spread the directories left over. A fixed number of tasks, because adaptive
        # execution would merge so little data into one.
        pending = found.filter("is_dir").select("path").repartition(width)
        if pending.isEmpty():
            break
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files.drop("is_dir")


def list_visible_files(spark: SparkSession, root: str) -> DataFrame:
    """The same record by Spark's binary source, for file systems only Spark can reach.

    Contents are pruned, so nothing is read. Empty files, hidden names and creation
    times are missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        "length",
        F.lit(None).cast("timestamp").alias("created"),
        F.col("modificationTime").alias("modified"),
        F.lit("ok").alias("status"),
        F.lit("").alias("note"),
    )


def open_file(path: str):
    """A binary stream of a local or remote file."""
    if _is_local(path):
        return open(path, "rb")
    system, name = _filesystem(path)
    return system.open_input_stream(name)


def open_seekable(path: str):
    """The same for reading from any place."""
    if _is_local(path):
        return open(path, "rb")
    system, name = _filesystem(path)
    return system.open_input_file(name)


def _head(path: str) -> tuple[bytes | None, str]:
    try:
        with open_file(path) as stream:
            return stream.read(HEAD_BYTES), ""
    except OSError as error:
        return None, str(error)


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), HEAD_ROWS):
            chunk = batch.iloc[start : start + HEAD_ROWS]
            heads = [_head(path) for path in chunk["path"]]
            yield chunk.assign(head=[h for h, _ in heads], head_error=[e for _, e in heads])


def read_heads(files: DataFrame) -> DataFrame:
    """Add ``head``, the first bytes of each file, and ``head_error``.

    Spark's binary source would read every file whole for the same purpose. A listing
    is small for its number of files, so tasks are set by files, not by bytes.
    """
    width = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(width, -(-files.count() // TASK_FILES))
    schema = T.StructType([*files.schema.fields])
    schema = schema.add("head", T.BinaryType()).add("head_error", T.StringType())
    return files.repartition(tasks).mapInPandas(_read_heads, schema)
