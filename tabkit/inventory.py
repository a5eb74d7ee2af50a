"""Inventory of a file tree."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.files import categorise, detected_type, folder_of, name_of, size_mb, suffix_of
from tabkit.lookups import AUDIT_COLUMNS, SCAN_FAILED, SCAN_OK
from tabkit.session import stage
from tabkit.sources.file_tree import list_files, read_heads

RECORD = ["path", "folder", "name", "ext", "created", "modified", "size_mb", "category", "detected"]


def file_records(listing: DataFrame, detected: Column | None = None) -> DataFrame:
    """Records from a listing ``(path, length, created, modified)``."""
    name = name_of(F.col("path"))
    records = listing.select(
        "path",
        folder_of(F.col("path")).alias("folder"),
        name.alias("name"),
        suffix_of(name).alias("ext"),
        "created",
        "modified",
        size_mb(F.col("length")).alias("size_mb"),
        (F.lit("unknown") if detected is None else detected).alias("detected"),
    )
    return categorise(records).select(*RECORD)


def detection(head: Column) -> Column:
    """Type by the first bytes; 'error' where they could not be read."""
    return F.when(head.isNull(), "error").otherwise(detected_type(head))


def scan_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(records, audit)`` of all files below ``root``.

    The first bytes travel with the listing rows, from the task that opened the file
    to the projection that names the type, without a shuffle.
    """
    listing = list_files(spark, root)
    good = listing.filter(F.col("status") == "ok").select("path", "length", "created", "modified")
    records = stage(file_records(read_heads(good), detection(F.col("head"))), "records")
    # Staged, so that every use of the audit has the same times.
    return records, stage(audit_rows(listing, records), "audit")


def audit_event(spark: SparkSession, event: str, where: str, remark: str = "") -> DataFrame:
    """One audit row for something done now, such as a saved output."""
    time, action, path, note = AUDIT_COLUMNS
    moment = datetime.now(timezone.utc)
    return spark.createDataFrame(
        [(moment, event, where, remark)], f"`{time}` timestamp, `{action}` string, `{path}` string, `{note}` string"
    )


def audit_rows(listing: DataFrame, records: DataFrame) -> DataFrame:
    """One audit row per scanned file: time, action, path, note. The time is that of the
    action that runs this; :func:`scan_tree` stages it."""
    time, action, path, note = AUDIT_COLUMNS
    now = F.current_timestamp()
    done = records.select(
        now.alias(time), F.lit(SCAN_OK).alias(action), F.col("path").alias(path), F.col("category").alias(note)
    )
    failed = listing.filter(F.col("status") == "failed").select(
        now.alias(time), F.lit(SCAN_FAILED).alias(action), F.col("path").alias(path), F.col("note").alias(note)
    )
    return done.unionByName(failed)
