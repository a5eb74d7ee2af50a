"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.session import stage

#: What operators keep in a Python worker between its tasks, caches only.
WORKER_CACHES: dict[tuple, Any] = {}

#: Bits of the filter that keeps rows out of a shuffle: 16 MB at most.
FILTER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null text as empty. Other columns, whatever their names,
    go no further, so they cannot clash with those an operator makes."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def chunks(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``max_bytes``, one row at least, so
    that a task's working memory does not follow the length of its texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


@contextmanager
def small_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> Iterator[None]:
    """Jobs that run inside the block hand texts to Python in batches of about
    ``max_bytes``, however long the texts are; a batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Give free memory back to the system. Workers outlive their tasks, and what their
    allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def drop_caches() -> None:
    WORKER_CACHES.clear()


def tidied(function: Callable) -> Callable:
    """A task function that begins and ends without memory it does not use; what other
    operators have kept in its worker goes too."""

    @wraps(function)
    def run(batches):
        drop_caches()
        release_memory()
        yield from function(batches)
        release_memory()

    return run


def record_batch(columns: dict[str, Any], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[field.name], type=field.type) for field in schema], schema=schema
    )


def task_count(rows: int, per_task: int, at_least: int = 1) -> int:
    """How many tasks keep each at about ``per_task`` rows."""
    return max(at_least, -(-rows // per_task))


def text_number(text: Column) -> Column:
    """A hash that tells texts of one id apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 31))


def split_by_key(
    rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, bits: int = FILTER_BITS
) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the wanted ones, and those whose key is not, by a
    bitmap over key hashes.

    The bitmap has ``bits`` bits whatever the input, so it may be broadcast. While the
    wanted keys are fewer than its bits, few others are among the first; an exact join
    has to follow for these. ``wanted`` should be staged, as it is read twice.
    """
    bits = min(bits, max(1 << 12, 1 << (16 * wanted.count()).bit_length()))

    def bit(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    words = (
        wanted.select(bit(F.col(wanted_key)).alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")).alias("_set"))
    )
    pages = (
        words.groupBy(F.shiftright("_word", 6).alias("_page"))
        .agg(F.map_from_entries(F.collect_list(F.struct((F.col("_word") % 64).alias("at"), "_set"))).alias("_sets"))
        .select(
            "_page",
            F.transform(
                F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("_sets")[i.cast("long")], F.lit(0))
            ).alias("_sets"),
        )
    )
    names = rows.columns
    marked = rows.select(*[rows[quoted(c)].alias(f"_row {c}") for c in names], bit(key).alias("_bit"))
    joined = marked.join(F.broadcast(pages), F.shiftright(F.col("_bit"), 12) == F.col("_page"), "left")
    hit = F.expr("shiftright(_sets[CAST((_bit >> 6) & 63 AS INT)], CAST(_bit & 63 AS INT)) & 1") == 1
    hit = F.coalesce(hit, F.lit(False))
    back = [F.col(quoted(f"_row {c}")).alias(c) for c in names]
    return joined.filter(hit).select(*back), joined.filter(~hit).select(*back)


def semi_reduce(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be among the wanted ones, see ``split_by_key``."""
    return split_by_key(rows, rows[key], wanted, wanted_key, bits)[0]


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none is among ``names`` in any case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def drop_documents(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not among ``dropped (doc_id, tid)``, all columns.
    Of the texts only those move that may have to go."""
    gone, number = unused(docs.columns, "_dropped", "_tid")
    dropped = stage(dropped.select(F.col("doc_id").alias(gone), F.col("tid").alias(number)).distinct(), "dropped")
    unsure, clear = split_by_key(docs, docs[id_col].cast("long"), dropped, gone)
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    same = F.col(quoted(id_col)).cast("long").eqNullSafe(F.col(gone)) & (text_number(text) == F.col(number))
    return clear.unionByName(unsure.join(dropped, same, "left_anti"))
