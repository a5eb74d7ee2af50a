"""Writing results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.files import file_link, relative_output_path, relative_path, time_text
from tabkit.functions.text import quoted
from tabkit.inventory import audit_event
from tabkit.lookups import INVENTORY_COLUMNS, ROWS_COLUMN, SAVED_CSV, SAVED_TABLES
from tabkit.operators.delimited import DelimitedTree, pad_fields
from tabkit.operators.parts import category_parts, category_rollup, row_limit
from tabkit.session import stage, staging
from tabkit.sources.file_tree import tree_root
from tabkit.tree_sink import write_tree


def run_path(base: str, name: str, moment: datetime) -> str:
    """Output path of one run, e.g. ``base/name_20240131_235959``."""
    return f"{base.rstrip('/')}/{name}_{moment:%Y%m%d_%H%M%S}"


def inventory_export(records: DataFrame) -> DataFrame:
    """The nine report columns; the link column is the plain path."""
    texts = {"created": time_text(F.col("created")), "modified": time_text(F.col("modified"))}
    return records.select(*[texts.get(c, F.col(c)).alias(title) for c, title in INVENTORY_COLUMNS])


def write_inventory_csv(records: DataFrame, path: str) -> DataFrame:
    """CSV with header and byte order mark in every part file; returns its audit row."""
    export = inventory_export(records)
    first = export.columns[0]
    marked = export.withColumnRenamed(first, "﻿" + first)
    marked.write.csv(
        path,
        header=True,
        escape='"',
        emptyValue="",
        lineSep="\r\n",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return audit_event(records.sparkSession, SAVED_CSV, path)


def write_inventory(records: DataFrame, audit: DataFrame, path: str, link_folder: bool = False) -> DataFrame:
    """The parts, their summary with its total, and the run log, below ``path``; returns
    the audit row of the save."""
    parts = write_category_parts(records, f"{path}/parts", link_folder)
    category_rollup(parts).write.parquet(f"{path}/summary")
    append_audit(audit, f"{path}/log")
    return audit_event(records.sparkSession, SAVED_TABLES, path)


def write_category_parts(records: DataFrame, path: str, link_folder: bool = False) -> DataFrame:
    """One directory per category and part; returns the parts.

    Rows are spread by category *and* part, so a large category is written by many
    tasks and each holds no more than a part.
    """
    limit = row_limit(link_folder)
    parts = category_parts(records, limit)
    linked = parts.withColumn("link", file_link(F.col("path")))
    if link_folder:
        linked = linked.withColumn("folder_link", file_link(F.col("folder")))
    (
        linked.repartition("category", "part")
        .sortWithinPartitions("category", "part", "path")
        .write.option("maxRecordsPerFile", limit)
        .partitionBy("category", "part")
        .parquet(path)
    )
    return parts


def write_grouped(result: DataFrame, sum_cols: list[str], path: str, first: str | None = None) -> None:
    """Typed output of a group aggregate: count bigint, sums double, the rest text.

    ``first`` names the column that ``group_aggregate`` added under that option: the
    files, in the order of their names, then hold the groups in first-seen order, and
    the column itself is left out. Rows are range partitioned for it.
    """
    types = {ROWS_COLUMN: "bigint"} | dict.fromkeys(sum_cols, "double")
    if first:
        key = result.columns[1]
        result = result.orderBy(quoted(first), quoted(key)).drop(first)
    result.select(
        *[F.col(quoted(c)).cast(types.get(c, "string")).alias(c) for c in result.columns]
    ).write.parquet(path)


def append_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").parquet(path)


def _csv_line(fields: Column) -> Column:
    """RFC 4180 text of an array of fields."""
    quote = F.lit('"')

    def cell(text: Column) -> Column:
        escaped = F.concat(quote, F.replace(text, quote, F.lit('""')), quote)
        return F.when(text.rlike('[",\r\n]'), escaped).otherwise(text)

    return F.array_join(F.transform(fields, cell), ",")


def _output_files(tree: DelimitedTree) -> DataFrame:
    """``(path, rel_path, header, names, header_id)`` per file; staged, so that its size
    is known when it is joined to the lines.

    ``rel_path`` is the path below the root without its extension, with it where another
    file would get, or has, the same name without.
    """
    files = tree.files.filter(F.col("header").isNotNull()).select("path", "header", "names")
    files = files.withColumn("whole", relative_path(F.col("path"), tree.root))
    files = files.withColumn("stem", relative_output_path(F.col("path"), tree.root))
    taken = files.select("stem").union(files.select("whole"))
    shared = taken.groupBy("stem").agg((F.count("*") > 1).alias("shared"))
    rel_path = F.when(F.col("shared"), F.col("whole")).otherwise(F.col("stem"))
    header_id = F.sha2(F.to_json(F.struct("header")), 256)
    return stage(
        files.join(shared, "stem").select("path", rel_path.alias("rel_path"), "header", "names", header_id.alias("header_id")),
        "headers",
    )


def _mirrored_lines(tree: DelimitedTree) -> DataFrame:
    """``(rel_path, block, line_id, first, value)``: header and rows as CSV text; ``first``
    for those of a file's first block with any."""
    names = _output_files(tree).select("path", "rel_path", "names")
    lines = tree.split.filter(F.col("kind").isin("header", "row")).join(names, "path")
    fields = F.when(F.col("kind") == "header", F.col("names")).otherwise(
        pad_fields(F.col("fields"), F.col("header"))
    )
    first = F.col("block") == F.col("header_block")
    return lines.select("rel_path", "block", "line_id", first.alias("first"), _csv_line(fields).alias("value"))


def write_mirrored(tree: DelimitedTree, path: str) -> None:
    """Every file as CSV text, in one job, partitioned by a column ``rel_path``.

    The column holds the whole relative path, which Spark's readers give back; its
    folders are one level deep, with the slashes escaped. The header line stays where it
    was read, so lines are written by the tasks that read them: no shuffle, and a large
    file becomes several parts.
    """
    (
        _mirrored_lines(tree)
        .sortWithinPartitions("rel_path", "block", "line_id")
        .select("rel_path", "value")
        .write.partitionBy("rel_path")
        .text(path)
    )


def write_nested(tree: DelimitedTree, path: str, extension: str = ".csv") -> None:
    """Every file as ``<path>/<folders below the root>/<name>.csv``, in one job.

    A file that was read in several byte ranges gives a file for each, written by the
    task that read it: ``name.csv`` begins with the header, ``name@<start>.csv`` follow in
    the order of their names, without it. Files without rows have their header only; files
    without a usable header have none. ``path`` must be empty or not exist. ``_SUCCESS``
    is written last. An output whose name a folder already has fails the job.
    """
    lines = _mirrored_lines(tree).sortWithinPartitions("rel_path", "block", "line_id")
    part = F.when(F.col("first"), "").otherwise(F.format_string("@%015d", "block"))
    place = F.concat("rel_path", part, F.lit(extension))
    write_tree(lines.select(place.alias("place"), "value"), tree_root(tree.files.sparkSession, path), "lines")


def write_tables(tree: DelimitedTree, path: str) -> list[tuple[str, list[str]]]:
    """Parquet tables, one per distinct header; returns ``(table path, names)``.

    All are written by one job, whatever the number of headers, by the tasks that read
    the lines. A table's first column is the file a row comes from: ``rel_path``, with
    more underscores where the header has that name. Files hold rows in that order. A
    header without rows gives an empty table.
    """
    spark = tree.files.sparkSession
    with staging(spark):
        ids = _output_files(tree)
        lines = tree.split.filter(F.col("kind").isin("header", "row"))
        lines = lines.join(ids.select("path", "rel_path", "header_id", "names"), "path")
        fields = F.when(F.col("kind") == "row", pad_fields(F.col("fields"), F.col("header")))
        rows = lines.select(F.col("header_id").alias("folder"), "rel_path", "block", "line_id", "names", fields.alias("fields"))
        ordered = rows.sortWithinPartitions("folder", "rel_path", "block", "line_id").drop("block", "line_id")
        write_tree(ordered, tree_root(spark, path), "tables")
        found = ids.groupBy("header_id").agg(F.first("names").alias("names"))
        return [(f"{path}/{r['header_id']}", r["names"]) for r in found.collect()]


@contextmanager
def _case_sensitive(spark: SparkSession, needed: bool) -> Iterator[None]:
    """Headers may hold names that differ only in case; their readers need the same setting."""
    before = spark.conf.get("spark.sql.caseSensitive")
    if needed:
        spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
