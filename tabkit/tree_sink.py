"""A tree of files written in one job, as a Spark data source.

Rows come sorted within their tasks, and a task has one file open at a time. It writes
to a folder of its own attempt below ``<root>/_writing-<job>`` and lists there which
file goes where. The commit, which sees successful attempts only, moves the files to
their places one listing after another and marks the tree by ``_SUCCESS`` last, so that
a retried or speculative task leaves nothing double. A file is never replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tabkit.sources.file_tree import file_system

WORK, DONE = "_writing-", "_SUCCESS"
#: Moves that the commit has under way at a time.
MOVERS = 16
ROW_GROUP_BYTES = 32 << 20


@dataclass
class Written(WriterCommitMessage):
    """Where one task listed its files."""

    listing: str


class TreeWriter(DataSourceArrowWriter):
    #: Folders that are marked even if no file lies there.
    always_marked: tuple[str, ...] = ()

    def __init__(self, root: str):
        system, self.base = file_system(root)
        self.root, self.work = root, f"{self.base}/{WORK}{uuid.uuid4().hex}"
        found = system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        if any(not info.base_name.startswith(WORK) for info in found):
            raise FileExistsError(f"{root} is not empty")

    def files(self, system: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        """Write files into ``folder``; gives the name and the place of each, when closed."""
        raise NotImplementedError

    def marked(self, place: str) -> str:
        """The folder that gets the mark of a file's place."""
        return ""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _ = file_system(self.root)
        folder = f"{self.work}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        listing = f"{folder}/listing"
        with system.open_output_stream(listing) as out:
            for name, place in self.files(system, folder, iterator):
                out.write(json.dumps([f"{folder}/{name}", place]).encode() + b"\n")
        return Written(listing)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.root)
        marks = set(self.always_marked)

        def move(entry: bytes) -> str:
            source, place = json.loads(entry)
            target = f"{self.base}/{place}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            if system.get_file_info(target).type != fs.FileType.NotFound:
                raise FileExistsError(f"{target} exists: a folder or another file has its name")
            system.move(source, target)
            return self.marked(place)

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in messages:
                if message is not None:
                    with system.open_input_stream(message.listing) as listing:
                        marks.update(pool.map(move, listing.read().splitlines()))
        for folder in marks:
            path = f"{self.base}/{folder}".rstrip("/")
            system.create_dir(path, recursive=True)
            system.open_output_stream(f"{path}/{DONE}").close()
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(file_system(self.root)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        if system.get_file_info(self.work).type == fs.FileType.Directory:
            system.delete_dir(self.work)


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices of a batch with the same value of a column."""
    encoded = pc.run_end_encode(batch.column(column))
    start = 0
    for value, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist()):
        yield value, batch.slice(start, end - start)
        start = end


class LineFiles(TreeWriter):
    """Text files of ``(place, value)``: a line per row."""

    always_marked = ("",)

    def files(self, system, folder, batches):
        place, out, number = None, None, 0
        for batch in batches:
            for value, rows in _runs(batch, "place"):
                if value != place:
                    if out:
                        out.close()
                        yield str(number), place
                        number += 1
                    place, out = value, system.open_output_stream(f"{folder}/{number}")
                out.write("".join(line + "\n" for line in rows.column("value").to_pylist()).encode())
        if out:
            out.close()
            yield str(number), place


class TableFiles(TreeWriter):
    """Parquet files of ``(folder, rel_path, names, fields)``, a table per folder, whose
    columns are ``names`` after one for ``rel_path``. A row without fields adds none, but
    its table exists."""

    def marked(self, place):
        return place.partition("/")[0]

    def files(self, system, folder, batches):
        part = uuid.uuid4().hex
        table, out, number = None, None, 0
        for batch in batches:
            for value, rows in _runs(batch, "folder"):
                if value != table:
                    if out:
                        out.close()
                        yield str(number), f"{table}/part-{part}-{number}.parquet"
                        number += 1
                    table, out = value, _Table(system, f"{folder}/{number}", rows.column("names")[0].as_py())
                out.add(rows)
        if out:
            out.close()
            yield str(number), f"{table}/part-{part}-{number}.parquet"


class _Table:
    """One Parquet file; rows are held until they make a row group."""

    def __init__(self, system: fs.FileSystem, path: str, names: list[str]):
        self.schema = pa.schema([(name, pa.string()) for name in [file_column(names), *names]])
        self.stream = system.open_output_stream(path)
        self.writer = pq.ParquetWriter(self.stream, self.schema)
        self.held: list[pa.Table] = []

    def add(self, rows: pa.RecordBatch) -> None:
        rows = rows.filter(rows.column("fields").is_valid())
        width = len(self.schema) - 1
        cells = rows.column("fields").flatten()
        columns = [cells.take(pa.array(range(i, len(cells), width), pa.int64())) for i in range(width)]
        self.held.append(pa.Table.from_arrays([rows.column("rel_path"), *columns], schema=self.schema))
        if sum(t.nbytes for t in self.held) > ROW_GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        self.writer.write_table(pa.concat_tables(self.held))
        self.held = []

    def close(self) -> None:
        if self.held:
            self._flush()
        self.writer.close()
        self.stream.close()


def file_column(names: list[str]) -> str:
    """A name for the column of file paths that no other column has."""
    column = "rel_path"
    while column in {name.lower() for name in names}:
        column += "_"
    return column


class FileTree(DataSource):
    """Options: ``root``, a folder that is empty or does not exist, and ``files``,
    'lines' or 'tables'."""

    @classmethod
    def name(cls) -> str:
        return "tabkit_file_tree"

    def writer(self, schema, overwrite):
        kinds = {"lines": LineFiles, "tables": TableFiles}
        return kinds[self.options["files"]](self.options["root"])


def write_tree(rows: DataFrame, root: str, files: str) -> None:
    """Write rows that are sorted by their files within each task."""
    rows.sparkSession.dataSource.register(FileTree)
    rows.write.format(FileTree.name()).options(root=root, files=files).mode("append").save()
