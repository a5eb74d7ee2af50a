"""Trees of delimited text files: lines, their encoding, decoded text."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.session import private_session
from tabkit.sources.file_tree import open_file

TEXT_FILES = "*.[tT][xX][tT]"
# What is read of a file before its separator is judged.
SAMPLE_LINES, SAMPLE_BYTES = 200, 1 << 16


def plain_path(uri: Column) -> Column:
    """A path without the ``file:`` scheme and URI escapes, to compare with listings."""
    # url_decode would also turn '+' into a blank.
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def reading_session(spark: SparkSession) -> SparkSession:
    """A session in which files are always cut alike.

    Spark cuts inputs by its settings and, up to some GB, by the cores it has at the
    moment. Line numbers of one pass must hold in the next, also when executors come
    and go or the user's settings change in between.
    """
    names = ["maxPartitionBytes", "openCostInBytes"]
    cuts = {f"spark.sql.files.{n}": spark.conf.get(f"spark.sql.files.{n}") for n in names}
    least = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    cuts["spark.sql.files.minPartitionNum"] = least
    most = spark.conf.get("spark.sql.files.maxPartitionNum", None)
    # Without a largest number Spark sets none; one that is never reached pins that.
    cuts["spark.sql.files.maxPartitionNum"] = most or str(2**31 - 1)
    return private_session(spark, **cuts)


def read_lines(spark: SparkSession, root: str, pattern: str = TEXT_FILES) -> DataFrame:
    """Every line below ``root``: ``(uri, block, line_id, line)``.

    ``line`` keeps the raw bytes, less a UTF-8 byte order mark. Large files are read
    in blocks by many tasks; ``(block, line_id)`` orders the lines of a file. ``line_id`` is
    taken right above the scan, so each use of this frame numbers alike as long as files
    are cut alike: give a :func:`reading_session`.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return files.select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )


def _lines(stream) -> Iterator[bytes]:
    """Raw lines of a binary stream, broken at LF, CR and CR LF as Spark breaks them,
    less a byte order mark."""
    # Latin-1 maps bytes to characters one to one.
    with io.TextIOWrapper(stream, "latin-1") as text:
        for number, line in enumerate(text):
            raw = line.removesuffix("\n").encode("latin-1")
            yield raw.removeprefix(b"\xef\xbb\xbf") if number == 0 else raw


def _heads_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, uri, first_id in zip(batch["path"], batch["uri"], batch["first_id"]):
            try:
                with open_file(path) as stream:
                    head = stream.read(SAMPLE_BYTES + 1)
            except OSError:
                continue  # judged by all its lines, whose reader reports what is wrong
            lines = list(_lines(io.BytesIO(head[:SAMPLE_BYTES])))
            if len(head) > SAMPLE_BYTES:
                lines.pop()  # cut off in the middle
            lines = lines[:SAMPLE_LINES]
            yield pd.DataFrame({"uri": uri, "block": 0, "line_id": range(first_id, first_id + len(lines)), "line": lines})


def read_first_lines(statistics: DataFrame) -> DataFrame:
    """The first whole lines of each file (``uri`` is its path), numbered as its other
    lines are, from its first bytes: ``SAMPLE_LINES`` lines and ``SAMPLE_BYTES`` bytes at
    most."""
    files = statistics.select(F.col("uri").alias("path"), "uri", "first_id")
    width = files.sparkSession.sparkContext.defaultParallelism
    lines = files.repartition(width).mapInPandas(_heads_of, "uri string, block bigint, line_id bigint, line binary")
    return lines.withColumn("line", F.col("line").cast("string"))


def _decode_line(raw: bytes) -> str | None:
    try:
        return raw.decode("gb18030")
    except UnicodeDecodeError:
        return None


def _decode_batch(batch: pd.Series) -> list[str | None]:
    """Texts of a batch of lines, decoded in one go unless one of them is not valid.

    No multi-byte character holds a line feed, so joined lines decode as single ones.
    """
    raw = [b"" if line is None else line for line in batch]
    try:
        texts = b"\n".join(raw).decode("gb18030").split("\n")
    except UnicodeDecodeError:
        texts = []
    return texts if len(texts) == len(raw) else [_decode_line(line) for line in raw]


@F.pandas_udf(T.StringType())
def gb18030_text(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of GB18030 bytes, null where they are not valid."""
    for batch in lines:
        yield pd.Series(_decode_batch(batch), dtype=object)


@F.pandas_udf(T.BooleanType())
def is_gb18030(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in lines:
        yield pd.Series([text is not None for text in _decode_batch(batch)])


def line_statistics(lines: DataFrame) -> DataFrame:
    """``(uri, utf8, n_lines, first_id)`` per file; folds to one row per file in each
    task. ``first_id`` is the number of the file's first line. With lines from
    ``byte_ranges`` also ``error``, what kept one of the file's ranges from being read."""
    errors = [F.max("error").alias("error")] if "error" in lines.columns else []
    return lines.groupBy("uri").agg(
        F.bool_and(F.is_valid_utf8("line")).alias("utf8"),
        F.count("line").alias("n_lines"),
        F.min(F.when(F.col("block") == 0, F.col("line_id"))).alias("first_id"),
        *errors,
    )


def resolve_encodings(lines: DataFrame, statistics: DataFrame) -> DataFrame:
    """``(uri, n_lines, encoding)``: the first of UTF-8, GB18030, Latin-1 that decodes
    all of a file.

    Only lines of files that are not UTF-8, and of those only lines beyond ASCII, go
    through the Arrow function. Much Latin-1 text is valid GB18030 too and is taken as
    such, by that order.
    """
    suspects = statistics.filter(~F.col("utf8")).select("uri")
    ascii_line = F.is_valid_utf8("line") & (F.octet_length("line") == F.char_length("line"))
    high = lines.join(suspects, "uri", "left_semi").filter(~ascii_line)
    valid = is_gb18030(F.col("line").cast("binary"))
    gb = high.select("uri", valid.alias("valid")).groupBy("uri").agg(F.bool_and("valid").alias("gb"))
    encoding = F.when(F.col("utf8"), "utf-8").when(F.col("gb"), "gb18030").otherwise("latin1")
    return statistics.join(gb, "uri", "left").select("uri", "n_lines", encoding.alias("encoding"))


def decode_lines(lines: DataFrame, only_utf8: bool) -> DataFrame:
    """Replace ``line`` by its text under the file's ``encoding`` column.

    UTF-8 lines keep to the JVM: they form a branch of their own, since a Python
    function inside a ``when`` would still see every row.
    """
    if only_utf8:
        return lines
    raw = F.col("line").cast("binary")
    is_gb = F.col("encoding") == "gb18030"
    text = F.when(is_gb, gb18030_text(F.when(is_gb, raw))).otherwise(F.decode(raw, "ISO-8859-1"))
    utf8 = lines.filter(F.col("encoding") == "utf-8")
    return utf8.unionByName(lines.filter(F.col("encoding") != "utf-8").withColumn("line", text))
