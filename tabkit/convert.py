"""Convert a tree of delimited text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.separators import AUTO, Separator
from tabkit.operators.delimited import (
    DelimitedTree,
    conversion_status,
    detect_separator,
    split_rows,
    with_repaired_names,
)
from tabkit.session import stage
from tabkit.sources.byte_ranges import cut_ranges, file_ranges, in_tasks, range_bytes, read_ranges, weight
from tabkit.sources.file_tree import list_files, tree_root
from tabkit.sources.text_tree import decode_lines, line_statistics, read_first_lines, resolve_encodings


def resolve_files(lines: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Staged ``(uri, n_lines, first_id, encoding)`` of every file that has lines."""
    if statistics is None:
        statistics = stage(line_statistics(lines), "statistics")
    if statistics.filter("NOT utf8").isEmpty():
        return statistics.select("uri", "n_lines", "first_id", F.lit("utf-8").alias("encoding"))
    encodings = resolve_encodings(lines, statistics).select("uri", "encoding")
    return stage(statistics.select("uri", "n_lines", "first_id").join(encodings, "uri"), "encodings")


def parse_lines(
    lines: DataFrame,
    sep: Separator = AUTO,
    path_of=lambda uri: uri,
    statistics: DataFrame | None = None,
    first_lines=None,
) -> tuple[DataFrame, DataFrame]:
    """Per-file facts and all lines split (lazy), for any frame of lines.

    ``path_of`` turns the ``uri`` of a file into the ``path`` of the results.
    ``first_lines`` reads the first lines of files by their facts, where that is
    cheaper than a pass over all lines.
    """
    files, only_utf8 = file_facts(lines, sep, path_of, statistics, first_lines)
    return files.drop("uri"), split_lines(lines, files, sep, only_utf8)


def file_facts(
    lines: DataFrame, sep: Separator, path_of, statistics: DataFrame | None, first_lines
) -> tuple[DataFrame, bool]:
    """The facts of each file, with its ``uri``, and whether all are UTF-8."""
    files = resolve_files(lines, statistics)
    only_utf8 = files.filter("encoding <> 'utf-8'").isEmpty()
    sample = first_lines(files) if first_lines else None
    files = detect_separator(lines, files, sep, only_utf8, lambda df: decode_lines(df, only_utf8), sample)
    return files.withColumn("path", path_of(F.col("uri"))), only_utf8


def split_lines(lines: DataFrame, files: DataFrame, sep: Separator, only_utf8: bool) -> DataFrame:
    """All lines of the files, split (lazy)."""
    # Read from a staged table, so Catalyst knows the size and broadcasts it only when
    # it is small. Paths are worked out there, once per file and not per line.
    facts = files.filter(F.col("status") == "ok").drop("status", "note", "n_lines")
    return split_rows(decode_lines(lines.join(facts, "uri").drop("uri"), only_utf8), sep)


def read_delimited_tree(spark: SparkSession, root: str, sep: Separator = AUTO) -> DelimitedTree:
    """Read every ``.txt`` file below ``root``, whatever its encoding and separator."""
    root = tree_root(spark, root)
    listing = list_files(spark, root)
    # What could not be listed may be a file of any name or a folder.
    listing = listing.filter((F.col("status") == "failed") | F.lower("path").endswith(".txt"))
    return read_listed(listing, root, sep)


def read_listed(listing: DataFrame, root: str, sep: Separator = AUTO) -> DelimitedTree:
    """Read listed files, see :func:`tabkit.sources.file_tree.list_files`.

    Two passes over the text: line counts, encodings and read errors, then, after the first
    bytes of each file gave its separator and header, all lines, split in one lazy plan. A
    file that cannot be opened, or not be read to its listed end, gets the status 'failed'
    with the error as its note, and none of its rows are kept. One that could be read in
    the first pass and no longer in the second fails the job, as its status is known by then.
    """
    ranges = file_ranges(listing.filter("status = 'ok'"), range_bytes(listing.sparkSession))
    lines = read_ranges(ranges)
    files, status, only_utf8 = _survey(listing, lines, sep)
    split = split_lines(lines.drop("error"), files, sep, only_utf8)
    return DelimitedTree(with_repaired_names(files.drop("uri")), split, status, root)


def read_parts(listing: DataFrame, root: str, sep: Separator = AUTO) -> Callable[[int], DelimitedTree]:
    """The same for a listing in parts of few files, numbered by its column ``part``: the
    first pass and the facts of all files in common, then the tree of any part, which
    reads no other lines."""
    ranges = cut_ranges(listing.filter("status = 'ok'"), range_bytes(listing.sparkSession), "part")
    sizes = {r["part"]: r["bytes"] for r in ranges.groupBy("part").agg(weight()).collect()}
    files, status, only_utf8 = _survey(listing, read_ranges(in_tasks(ranges, sum(sizes.values()))), sep)
    parts = listing.select("path", "part")
    files = stage(files.join(parts, "path"), "files", "part")
    status = stage(status.join(parts, "path"), "status", "part")

    def tree(part: int) -> DelimitedTree:
        def mine(df: DataFrame) -> DataFrame:
            return df.filter(F.col("part") == part).drop("part")

        lines = read_ranges(in_tasks(mine(ranges), sizes.get(part, 0)))
        split = split_lines(lines.drop("error"), mine(files), sep, only_utf8)
        return DelimitedTree(with_repaired_names(mine(files).drop("uri")), split, mine(status), root)

    return tree


def _survey(listing: DataFrame, lines: DataFrame, sep: Separator) -> tuple[DataFrame, DataFrame, bool]:
    """The facts of files with lines, the status of all, and whether all are UTF-8."""
    statistics = stage(line_statistics(lines), "statistics")
    errors = statistics.filter("error IS NOT NULL").select(F.col("uri").alias("path"), F.col("error").alias("_error"))
    read = statistics.filter("error IS NULL").drop("error")
    files, only_utf8 = file_facts(lines.drop("error"), sep, lambda uri: uri, read, read_first_lines)
    broken = F.col("_error").isNotNull()
    listing = listing.join(errors, "path", "left").select(
        "path",
        F.when(broken, "failed").otherwise(F.col("status")).alias("status"),
        F.when(broken, F.col("_error")).otherwise(F.col("note")).alias("note"),
    )
    return files, conversion_status(listing, files.drop("uri")), only_utf8
