"""Categories cut into parts of limited rows, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.files import part_title
from tabkit.lookups import PART_ROWS, PART_ROWS_LINKED, SUMMARY_COLUMNS, TOTAL_LABEL
from tabkit.operators.ranking import with_position


def row_limit(link_folder: bool) -> int:
    return PART_ROWS_LINKED if link_folder else PART_ROWS


def category_parts(records: DataFrame, limit: int, order_by: str = "path") -> DataFrame:
    """Add ``part`` and ``title``: consecutive slices of at most ``limit`` rows per category."""
    placed = with_position(records, ["category"], [order_by])
    part = F.floor((F.col("position") - 1) / limit) + 1
    parts = F.ceil(F.col("group_size") / limit)
    return placed.withColumn("part", part).withColumn(
        "title", part_title(F.col("category"), F.col("part"), parts)
    ).drop("position", "group_size")


def category_summary(parts: DataFrame) -> DataFrame:
    """``(category, part, title, files, size_mb)`` per part; exact, as sizes have two places."""
    size = F.sum(F.col("size_mb").cast("decimal(18,2)")).cast("double")
    return parts.groupBy("category", "part", "title").agg(F.count("*").alias("files"), size.alias("size_mb"))


def category_rollup(parts: DataFrame) -> DataFrame:
    """The summary with its grand total row, under the report's column names."""
    size = F.sum(F.col("size_mb").cast("decimal(18,2)")).cast("double")
    label, files, total = SUMMARY_COLUMNS
    rolled = parts.rollup("title").agg(
        F.count("*").alias(files), F.coalesce(size, F.lit(0.0)).alias(total), F.grouping("title").alias("_total")
    )
    name = F.when(F.col("_total") == 1, TOTAL_LABEL).otherwise(F.col("title"))
    return rolled.select(name.alias(label), files, total)
