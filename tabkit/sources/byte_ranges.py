"""Lines of listed files by byte ranges, with a row instead of an exception for a range
that cannot be read.

Ranges come from our own listing as rows, so the driver holds no file index, and large
files of any name are read by many tasks. A range owns the lines that *begin* in it and
reads on to the end of the last of them. Lines break at LF, CR and CR LF, as in Spark's text
source. ``(block, line_id)``, the start of the range and the line's number in it, follow
from the listing alone: each pass numbers alike, whatever cuts tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.session import stage
from tabkit.sources.file_tree import open_seekable

#: What opening a file counts as, when tasks are set by bytes.
OPEN_BYTES = 1 << 20
TASK_BYTES = 64 << 20
READ_BYTES = 1 << 20
MARK = b"\xef\xbb\xbf"
LF, CR = 10, 13

LINES = "uri string, block long, line_id long, line binary, error string"
SCHEMA = pa.schema(
    [("uri", pa.string()), ("block", pa.int64()), ("line_id", pa.int64()), ("line", pa.binary()), ("error", pa.string())]
)


class Truncated(OSError):
    """A file ends before the length it was listed with."""


def range_bytes(spark: SparkSession) -> int:
    """The size that Spark's own file sources are set to cut at."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text.rstrip("kmgt")) << unit


def file_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """``(path, start, end)`` for listed ``files (path, length)``, staged, in tasks of
    about ``TASK_BYTES``; empty files have none."""
    ranges = cut_ranges(files, range_bytes)
    return in_tasks(ranges, ranges.agg(weight()).first()["bytes"] or 0)


def cut_ranges(files: DataFrame, range_bytes: int, by: str | None = None) -> DataFrame:
    """The same ranges, with the column ``by``, before they are dealt to tasks."""
    kept = [by] if by else []
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.filter("length > 0").select(*kept, "path", "length", starts.alias("start"))
    ranges = ranges.select(*kept, "path", "start", F.least("length", F.col("start") + range_bytes).alias("end"))
    return stage(ranges, "ranges", by)


def weight() -> Column:
    """The sum ``bytes`` by which ranges are dealt to tasks."""
    return F.sum(F.col("end") - F.col("start") + OPEN_BYTES).alias("bytes")


def in_tasks(ranges: DataFrame, bytes: int) -> DataFrame:
    width = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(width, -(-bytes // TASK_BYTES)))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``(uri, block, line_id, line, error)``: raw lines, less a byte order mark at the
    start of a file; ``uri`` is the path as it is listed.

    A range that cannot be opened or read to its end gives a row with null ``line`` and its
    ``error``, after the lines read until then.
    """
    lines = ranges.select("path", "start", "end").mapInArrow(_read, LINES)
    return lines.withColumn("line", F.col("line").cast("string"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "end")]):
            number = 0
            try:
                for lines in range_lines(path, start, end):
                    yield _rows(path, start, number, lines, None)
                    number += len(lines)
            except (OSError, ValueError, pa.ArrowException) as error:
                yield _rows(path, start, number, pa.nulls(1, pa.binary()), f"{type(error).__name__}: {error}")


def _rows(path: str, block: int, first: int, lines: pa.Array, error: str | None) -> pa.RecordBatch:
    n = len(lines)
    columns = [
        pa.repeat(pa.scalar(path), n),
        pa.repeat(pa.scalar(block, pa.int64()), n),
        pa.array(np.arange(first, first + n)),
        lines,
        pa.repeat(pa.scalar(error, pa.string()), n),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def range_lines(path: str, start: int, end: int) -> Iterator[pa.Array]:
    """The lines that begin in ``[start, end)``, in arrays of about ``READ_BYTES``.

    Raises :class:`Truncated` if the file ends before ``end``.
    """
    with open_seekable(path) as stream:
        # One byte earlier: whether a line begins at `start` depends on it.
        at = max(0, start - 1)
        stream.seek(at)
        held, inside = b"", start == 0
        while True:
            # Longer lines are read in steps that grow with them; past the end only a little.
            step = max(READ_BYTES if at + len(held) < end else READ_BYTES >> 4, len(held))
            more = stream.read(step)
            last = len(more) < step and not (tail := stream.read(1))
            if len(more) < step and not last:
                more += tail
            if last and at + len(held) + len(more) < end:
                raise Truncated(f"ends before byte {end}, with which it was listed")
            data = held + more
            stops, after = breaks(data, last)
            if not inside:
                if not len(after):
                    at, held = _kept(at, data)
                    if last or at >= end:
                        return
                    continue
                at, data, inside = at + int(after[0]), data[int(after[0]) :], True
                stops, after = stops[1:] - after[0], after[1:] - after[0]
            if last and (not len(after) or after[-1] < len(data)) and data:
                stops, after = np.append(stops, len(data)), np.append(after, len(data))
            begins = np.concatenate(([0], after))[:-1]
            owned = int(np.searchsorted(begins + at, end))
            if owned:
                lines = _slices(data, begins[:owned], stops[:owned])
                if at == 0 and data.startswith(MARK):
                    first = lines[0].as_py().removeprefix(MARK)
                    lines = pa.concat_arrays([pa.array([first], pa.binary()), lines[1:]])
                yield lines
            read = int(after[-1]) if len(after) else 0
            if last or owned < len(begins) or at + read >= end:
                return
            at, held = at + read, data[read:]


def _kept(at: int, data: bytes) -> tuple[int, bytes]:
    """While no line has begun, only a last CR matters: an LF may follow."""
    cut = len(data) - 1 if data.endswith(b"\r") else len(data)
    return at + cut, data[cut:]


def breaks(data: bytes, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where lines stop and where the next ones begin. A CR at the very end is a break
    only if nothing follows."""
    view = np.frombuffer(data, np.uint8)
    after = np.flatnonzero((view == LF) | (view == CR))
    if not len(after):
        return after, after
    is_cr = view[after] == CR
    follows = np.append(view, LF if not last else 0)[after + 1] == LF
    # Of CR LF the CR is dropped here, and the line stops one earlier.
    stops = after[~(is_cr & follows)]
    begins = stops + 1
    pair = (view[stops] == LF) & (stops > 0) & (view[np.maximum(stops, 1) - 1] == CR)
    return stops - pair, begins


def _slices(data: bytes, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The given slices as one array. What lies between them is cut out in one go."""
    edges = np.zeros(len(data) + 1, np.int8)
    np.add.at(edges, begins, 1)
    np.add.at(edges, stops, -1)
    kept = np.frombuffer(data, np.uint8)[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate(([0], np.cumsum(stops - begins))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
