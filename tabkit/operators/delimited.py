"""Lines of delimited files to rows: separator, header, bad rows, status per file.

Works on a frame of lines ``(uri, block, line_id, line)``, whichever source it comes from.
The numbers of one block's lines agree in their bits from the 33rd on, as those that one
task gives do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tabkit.functions.headers import repair_header, repaired_header
from tabkit.functions.separators import (
    AUTO,
    Separator,
    by_label,
    count_fields,
    is_blank_line,
    looks_unsplit,
    output_separators,
    split_fields,
)
from tabkit.functions.text import blank_missing
from tabkit.lookups import DETECTION_SAMPLE
from tabkit.operators.ranking import first_n_per_group
from tabkit.session import stage

ORDER = ["block", "line_id"]
# Physical lines read per file before a separator is judged.
SAMPLE_LINES = 200

REFUSED, ACCEPTED, UNDECIDED = 0, 1, 2


def _candidate_lines(lines: DataFrame, separators: Sequence[Separator], *keep: str) -> DataFrame:
    """One row per non-blank line and candidate: ``(uri, block, line_id, rank, width, line)``."""
    candidates = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"),
                count_fields(F.col("line"), sep).alias("width"),
                is_blank_line(F.col("line"), sep).alias("blank"),
            )
            for i, sep in enumerate(separators)
        ]
    )
    return (
        lines.select("uri", *keep, *ORDER, "line", F.explode(candidates).alias("c"))
        .select("uri", *keep, *ORDER, "line", "c.rank", "c.width", "c.blank")
        .filter(~F.col("blank"))
        .drop("blank")
    )


FILE = ["uri", "rank"]


def _fits() -> Column:
    return ~F.col("is_header") & (F.col("width") <= F.col("header_width"))


def _counts() -> list[Column]:
    return [
        F.max("header_width").alias("header_width"),
        F.count_if(~F.col("is_header")).alias("data_rows"),
        F.count_if(_fits()).alias("fitting_rows"),
    ]


def _sample_tallies(sample: DataFrame, separators: Sequence[Separator]) -> DataFrame:
    """Facts per file and candidate from bounded samples; the windows and the grouping
    all share the sample's shuffle by file."""
    rows = _candidate_lines(sample, separators)
    file = Window.partitionBy(*FILE).orderBy(*ORDER)
    rows = rows.withColumn("header_width", F.first("width").over(file))
    rows = rows.withColumn("is_header", F.row_number().over(file) == 1)
    seen = F.count_if(_fits()).over(file)
    suspect = _fits() & (F.col("header_width") == 1) & (seen <= DETECTION_SAMPLE) & looks_unsplit(F.col("line"))
    return (
        rows.withColumn("suspect", suspect)
        .groupBy(*FILE)
        .agg(
            *_counts(),
            F.bool_or("suspect").alias("suspect"),
            F.max(F.when(F.col("is_header"), F.struct(*ORDER, "line"))).alias("header"),
        )
    )


def _whole_tallies(lines: DataFrame, separators: Sequence[Separator]) -> DataFrame:
    """The same facts from all lines, for files of any size: first rows by group
    limits, counts by partial aggregation, never a whole file in one task."""
    rows = _candidate_lines(lines, separators)
    first = first_n_per_group(rows, FILE, ORDER, 1)
    headers = stage(
        first.select(*FILE, F.col("width").alias("header_width"), F.struct(*ORDER, "line").alias("header")),
        "headers",
    )
    facts = headers.select(*FILE, "header_width", "header.block", "header.line_id")
    facts = facts.withColumnsRenamed({"block": "header_block", "line_id": "header_line_id"})
    rows = rows.join(facts, FILE)
    is_header = (F.col("block") == F.col("header_block")) & (F.col("line_id") == F.col("header_line_id"))
    rows = rows.withColumn("is_header", is_header)
    single = first_n_per_group(rows.filter(_fits() & (F.col("header_width") == 1)), FILE, ORDER, DETECTION_SAMPLE)
    suspects = single.groupBy(*FILE).agg(F.bool_or(looks_unsplit(F.col("line"))).alias("suspect"))
    tallies = rows.groupBy(*FILE).agg(*_counts()).join(suspects, FILE, "left")
    tallies = tallies.withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    return tallies.join(headers.drop("header_width"), FILE)


def _verdict(auto: bool, complete: Column) -> Column:
    """Whether a candidate is the separator of a file, as far as its rows tell."""
    if not auto:
        return F.lit(ACCEPTED)
    one_column = F.col("header_width") == 1
    no_row_fits = F.col("fitting_rows") == 0
    return (
        F.when(F.col("suspect"), REFUSED)
        .when(complete & no_row_fits & (F.col("data_rows") > 0), REFUSED)
        .when(complete, ACCEPTED)
        .when(no_row_fits, UNDECIDED)
        .when(one_column & (F.col("fitting_rows") < DETECTION_SAMPLE), UNDECIDED)
        .otherwise(ACCEPTED)
    )


def _choose(
    tallies: DataFrame, files: DataFrame, separators: Sequence[Separator], auto: bool, complete: Column
) -> DataFrame:
    """First candidate of each file that is not refused; null where there is none.

    A candidate without any row yet is open as long as lines are left unread.
    """
    judged = tallies.join(files, "uri", "right").withColumn("verdict", _verdict(auto, complete))
    usable = F.col("rank").isNotNull() & (F.col("verdict") != REFUSED)
    first = F.min(F.when(usable, F.struct("rank", "verdict", "header")))
    chosen = judged.groupBy("uri", "n_lines", "encoding", complete.alias("_complete")).agg(
        first.alias("first"), F.count("rank").alias("seen")
    )
    unseen = ~F.col("_complete") & (F.col("seen") < len(separators))
    undecided = unseen | F.coalesce(F.col("first.verdict") == UNDECIDED, F.lit(False))
    return chosen.select(
        "uri",
        "n_lines",
        "encoding",
        F.col("first.rank").alias("rank"),
        F.col("first.header").alias("header"),
        undecided.alias("undecided"),
    )


def detect_separator(
    lines: DataFrame,
    files: DataFrame,
    sep: Separator = AUTO,
    only_utf8: bool = True,
    decode=None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Separator and header per file:
    ``(uri, n_lines, encoding, separator, header, header_line, header_block,
    header_line_id, status, note)``.

    ``files`` gives ``(uri, n_lines, encoding)``. Each file is judged by its first
    lines, given as ``sample`` or else taken from the first block. Only files these
    leave open are read as a whole, by a second job.
    """
    decode = decode or (lambda df: df)
    separators = output_separators(sep)
    auto = sep.kind == "auto"
    if sample is None:
        sample = first_n_per_group(lines.filter(F.col("block") == 0), ["uri"], ORDER, SAMPLE_LINES).drop("row_in_group")
    # Staged, for the count below and the tallies must be over the same lines.
    sample = stage(sample, "sample")
    sampled = sample.groupBy("uri").agg(F.count("*").alias("n_sampled"))
    judged = files.select("uri", "n_lines", "encoding").join(sampled, "uri", "left")
    judged = judged.withColumn("complete", F.coalesce(F.col("n_sampled") == F.col("n_lines"), F.lit(False)))
    if not only_utf8:
        sample = decode(sample.join(files.select("uri", "encoding"), "uri"))
    complete = F.col("complete")
    chosen = stage(_choose(_sample_tallies(sample, separators), judged, separators, auto, complete), "separators")

    open_files = chosen.filter("undecided").select("uri", "n_lines", "encoding")
    if not open_files.isEmpty():
        rest = decode(lines.join(open_files.select("uri", "encoding"), "uri"))
        whole = _choose(_whole_tallies(rest, separators), open_files, separators, auto, F.lit(True))
        chosen = stage(chosen.filter("NOT undecided").unionByName(whole), "separators")

    labels = F.array(*[F.lit(s.label) for s in separators])
    found = chosen.withColumn("separator", F.get(labels, F.col("rank")))
    fields = by_label(F.col("separator"), separators, lambda s: split_fields(F.col("header.line"), s))
    ok = F.col("rank").isNotNull()
    return found.select(
        "uri",
        "n_lines",
        "encoding",
        "separator",
        F.when(ok, fields).alias("header"),
        F.col("header.line").alias("header_line"),
        F.col("header.block").alias("header_block"),
        F.col("header.line_id").alias("header_line_id"),
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(ok, "").otherwise("no header line, or no separator fits").alias("note"),
    )


def split_rows(lines: DataFrame, sep: Separator = AUTO) -> DataFrame:
    """Split every line and say what became of it.

    ``lines`` are decoded and joined to the facts of :func:`detect_separator`. Adds ``fields``, ``header`` and ``kind``: 'header', 'blank', 'rejected' for more
    fields than the header has, or 'row'.
    """
    separators = output_separators(sep)
    label = F.col("separator")
    # Counting instead of the size of `fields`: a filter on `kind` moves down to the
    # scan, where it would split every line a second time.
    width = by_label(label, separators, lambda s: count_fields(F.col("line"), s))
    same_block = F.col("block") == F.col("header_block")
    at_header = same_block & (F.col("line_id") == F.col("header_line_id"))
    moved = F.raise_error(F.concat(F.lit("lines were numbered anew while reading "), F.col("path")))
    # A reader's row for what it could not read, of a file that could be read before.
    unread = F.raise_error(F.concat(F.lit("no longer readable to its end: "), F.col("path")))
    # All lines of a block are numbered by one task.
    other_task = same_block & (F.shiftright("line_id", 33) != F.shiftright("header_line_id", 33))
    kind = (
        F.when(F.col("line").isNull(), unread.cast("string"))
        .when(at_header & (F.col("line") == F.col("header_line")), "header")
        .when(at_header | other_task, moved.cast("string"))
        .when(by_label(label, separators, lambda s: is_blank_line(F.col("line"), s)), "blank")
        .when(width > F.size("header"), "rejected")
        .otherwise("row")
    )
    split = lines.withColumn("fields", by_label(label, separators, lambda s: split_fields(F.col("line"), s)))
    return split.withColumn("kind", kind)


def pad_fields(fields: Column, header: Column) -> Column:
    """Short rows get empty fields; missing tokens become ''."""
    padded = F.concat(fields, F.array_repeat(F.lit(""), F.size(header) - F.size(fields)))
    return F.transform(padded, blank_missing)


def kept_rows(split: DataFrame) -> DataFrame:
    """``(path, block, line_id, header, fields)`` of the data rows, fields as they came."""
    return split.filter(F.col("kind") == "row").select("path", *ORDER, "header", "fields")


def accepted_rows(split: DataFrame) -> DataFrame:
    """The data rows with as many fields as their header has, missing tokens blanked."""
    return kept_rows(split).withColumn("fields", pad_fields(F.col("fields"), F.col("header")))


def rejected_rows(split: DataFrame) -> DataFrame:
    """``(path, block, line_id, line, n_fields, expected)`` of the over-long rows."""
    rows = split.filter(F.col("kind") == "rejected")
    return rows.select(
        "path", *ORDER, "line", F.size("fields").alias("n_fields"), F.size("header").alias("expected")
    )


def name_fields(rows: DataFrame, header: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of one header as a table of text columns with repaired names.

    Takes :func:`kept_rows` and finishes field by field, which stays in generated code.
    """
    names = repair_header(header)
    return rows.select(*keep, *[blank_missing(F.get("fields", F.lit(i))).alias(n) for i, n in enumerate(names)])


def split_with_header(
    lines: DataFrame, header: Sequence[str], sep: Separator, order_by: Sequence[str] = ()
) -> DataFrame:
    """Text columns of lines whose header is known; column by column, so that Spark
    prunes unused fields and keeps to generated code."""
    fits = lines.filter(~is_blank_line(F.col("line"), sep))
    fits = fits.filter(count_fields(F.col("line"), sep) <= len(header))
    return name_fields(fits.withColumn("fields", split_fields(F.col("line"), sep)), header, keep=order_by)


def with_repaired_names(files: DataFrame) -> DataFrame:
    """Add ``names``: the repaired header of each file, worked out once per header."""
    headers = files.filter(F.col("header").isNotNull()).select("header").distinct()
    return files.join(headers.withColumn("names", repaired_header("header")), "header", "left")


def conversion_status(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of every listed file: ``(path, encoding, separator, status, note)``.

    Only the listing knows files without lines and what could not be listed; these
    fail, the latter with the listing's note.
    """
    listing = listing.select("path", F.col("status").alias("_listed"), F.col("note").alias("_listing_note"))
    unread = F.when(F.col("_listed") == "failed", F.col("_listing_note")).otherwise("no lines")
    return listing.join(files, "path", "left").select(
        "path",
        "encoding",
        "separator",
        F.coalesce("status", F.lit("failed")).alias("status"),
        F.when(F.col("status").isNull(), unread).otherwise(F.col("note")).alias("note"),
    )


def status_totals(status: DataFrame | GroupedData) -> DataFrame:
    """``(total, ok, failed)`` over all files, or per group."""
    return status.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def union_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Chunks of one table, matched by column name."""
    whole = chunks[0]
    for chunk in chunks[1:]:
        whole = whole.unionByName(chunk)
    return whole


@dataclass(frozen=True)
class DelimitedTree:
    """A parsed tree. Every frame but ``files`` is lazy.

    files     one row per file with lines: encoding, separator, header, names, status
    split     every line with its kind: header, blank, rejected or row
    rows      ``(path, block, line_id, header, fields)``
    rejected  ``(path, block, line_id, line, n_fields, expected)``
    status    one row per listed file, empty ones and failures included
    root      the tree's root as paths begin with it
    """

    files: DataFrame
    split: DataFrame
    status: DataFrame
    root: str

    @property
    def rows(self) -> DataFrame:
        return accepted_rows(self.split)

    def preview(self, n: int) -> DataFrame:
        """The first ``n`` data rows of every file; 0 gives all."""
        return first_n_per_group(self.rows, ["path"], ORDER, n).drop("row_in_group")

    @property
    def rejected(self) -> DataFrame:
        return rejected_rows(self.split)

    def table(self, header: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """The rows of all files with this header, under its repaired names."""
        same = F.col("header") == F.array(*[F.lit(name) for name in header])
        return name_fields(kept_rows(self.split).filter(same), header, keep)
