"""Convert a tree in chunks of files, so that a run that was stopped goes on.

A file stream hands out new files, a bounded number at a time, and keeps in its
checkpoint which were given. What of a file must be known before its rows can be read is
found for the chunks of a batch in common, since that takes many small jobs whatever
their size; then the chunks are written one by one. The files of a batch are dealt to
chunks there before their work begins, and each chunk that is finished is marked: after a
stop the same files form the same chunks again, and the first one without a mark
replaces whatever its first attempt left.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.convert import read_parts
from tabkit.functions.separators import AUTO, Separator
from tabkit.operators.delimited import DelimitedTree
from tabkit.session import delete_path, make_mark, path_exists, staging
from tabkit.sources.file_tree import tree_root
from tabkit.sources.text_tree import TEXT_FILES

#: What a chunk writes, in this order: a chunk whose status is there is whole.
PARTS = ("rows", "rejected", "status")
FILES_PER_CHUNK = 10_000
#: Small chunks share a batch up to so many files, and so many chunks at most. Chunk
#: numbers begin at a multiple of the latter in each batch.
BATCH_FILES, BATCH_CHUNKS = 2_000, 100


def convert_chunks(
    spark: SparkSession,
    root: str,
    path: str,
    checkpoint: str,
    sep: Separator = AUTO,
    files_per_chunk: int = FILES_PER_CHUNK,
) -> int:
    """Convert the ``.txt`` files below ``root`` that no earlier call with this
    ``checkpoint`` has converted; returns the number of chunks finished by this call.

    ``path`` holds ``rows``, ``rejected`` and ``status`` as in
    :class:`~tabkit.operators.delimited.DelimitedTree`, with a folder per chunk; read them
    with :func:`read_chunks`. Each call ends when all files that were there at its start
    are done. Chunks of less than ``BATCH_FILES`` files come several to a batch of the
    stream; numbers of chunks rise, with gaps. A file is taken once, by its path; a file
    that fails has its status row and is not tried again. Empty files and names that begin
    with '.' or '_' are not seen. The driver keeps the paths of all files, as Spark's file
    stream does.
    """
    base = tree_root(spark, root)
    chunks = max(1, min(BATCH_CHUNKS, BATCH_FILES // files_per_chunk))
    schema = T.StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")
    # Contents are never selected, so only the listing is read.
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", TEXT_FILES)
        .option("maxFilesPerTrigger", files_per_chunk * chunks)
        .load(root)
        .select(plain_listing("path").alias("path"), "length")
    )
    done = 0

    def batch(listed: DataFrame, number: int) -> None:
        nonlocal done
        session = listed.sparkSession
        dealt = dealt_files(listed, files_per_chunk, f"{checkpoint}/dealt/batch={number}")
        numbers = sorted(r["part"] for r in dealt.select("part").distinct().collect())
        marks = {part: f"{checkpoint}/finished/{number * BATCH_CHUNKS + part}" for part in numbers}
        left = [part for part in numbers if not path_exists(session, marks[part])]
        with staging(session):
            listing = dealt.filter(F.col("part").isin(left)).withColumns({"status": F.lit("ok"), "note": F.lit("")})
            tree = read_parts(listing, base, sep) if left else None
            for part in left:
                write_chunk(tree(part), path, number * BATCH_CHUNKS + part)
                make_mark(session, marks[part])
                done += 1

    stream = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    return done


def dealt_files(listed: DataFrame, files_per_chunk: int, path: str) -> DataFrame:
    """A batch's files with the number ``part`` of their chunk in it, as they were dealt
    when the batch was first seen."""
    session = listed.sparkSession
    if not path_exists(session, f"{path}/_SUCCESS"):
        place = F.row_number().over(Window.orderBy("path")) - 1
        # A batch that was formed for more files a chunk has no more chunks for it.
        size = F.greatest(F.lit(files_per_chunk), F.ceil(F.count("*").over(Window.partitionBy()) / BATCH_CHUNKS))
        part = F.floor(place / size).cast("int") if files_per_chunk < BATCH_FILES else F.lit(0)
        listed.withColumn("part", part).write.mode("overwrite").parquet(path)
    return session.read.schema("path string, length long, part int").parquet(path)


def plain_listing(path: str) -> Column:
    """A path of Spark's listing, which is not escaped, as our own listing has it."""
    return F.regexp_replace(path, "^file:/+", "/")


def write_chunk(tree: DelimitedTree, path: str, number: int) -> None:
    """Write one chunk's parts in place of what an attempt before has left of them."""
    delete_path(tree.status.sparkSession, f"{path}/status/chunk={number}")

    def write(part: str) -> None:
        getattr(tree, part).write.mode("overwrite").parquet(f"{path}/{part}/chunk={number}")

    *lines, status = PARTS
    # Both read the chunk's lines; small ones take longer to plan than to read.
    with ThreadPoolExecutor(len(lines)) as pool:
        for written in [pool.submit(inheritable_thread_target(tree.status.sparkSession)(write), part) for part in lines]:
            written.result()
    write(status)


def read_chunks(spark: SparkSession, path: str, part: str = "rows") -> DataFrame:
    """One part of all chunks that are whole, with the column ``chunk``.

    A chunk that was stopped half-way is left out until it is done again.
    """
    status = spark.read.parquet(f"{path}/status")
    if part == "status":
        return status
    return spark.read.parquet(f"{path}/{part}").join(status.select("chunk").distinct(), "chunk", "left_semi")
