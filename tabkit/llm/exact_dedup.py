"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each task digests its rows and sends, for every owner of a slice of the fingerprint
   range, the sorted distinct fingerprints as Golomb-Rice coded gaps.
2. An owner decodes what it was sent and answers each sender with a bitmap: which of
   its fingerprints came from another sender too.
3. Senders turn bitmaps into suspect documents. Only those texts are shuffled, and
   grouped by their bytes.

An owner gets a fingerprint once per sender however often it occurs, so a text that a
third of all rows hold is no hot key, and copies fold by the map-side combine before
the shuffle of texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.frames import chunks, drop_documents, record_batch, semi_reduce, task_count, text_number, texts_by_id
from tabkit.session import stage

#: Bits of a fingerprint. A chance agreement only makes a suspect more.
BITS = 48
#: Rows a sender holds before it sends, and fingerprints an owner is meant for.
ROWS_PER_MESSAGE = 500_000
HASHES_PER_OWNER = 2_000_000


def rice_encode(values: np.ndarray, limit: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values in ``[0, limit)`` as gaps: the parameter, the unary
    quotients and the remainders. The two streams lie apart, so both decode at once."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1, limit // max(1, len(values))))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    remainders = (gaps[:, None] >> shifts) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(remainders.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, remainders: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * k].reshape(n, k)
    low = (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + low, dtype=np.uint64)


def normalise(text: bytes) -> bytes:
    """Lower-case A-Z and nothing else, which is what ``bytes.lower`` does."""
    return text.lower()


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, tid)`` for every row; ``tid`` is a
    hash of the text as it is.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
    equal texts the row with the largest doc_id stays; a null doc_id is the smallest.
    Rows that repeat a doc_id *and* its text are one document with one decision, each
    counted in ``group_size``. Extra columns are ignored; an empty table gives none.
    """
    rows = texts_by_id(docs, id_col, text_col)
    staged = stage(_send(rows), "fingerprints")
    digests = staged.filter("owner IS NULL").select("doc_id", "sha", "tid")
    groups = _verify(rows, _suspects(staged))
    joined = digests.join(groups, "sha", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "tid",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    # Of rows that repeat a doc_id with different texts, each has its own decision.
    return drop_documents(docs, duplicates(docs, id_col, text_col).filter(~F.col("kept")), id_col, text_col)


def _send(rows: DataFrame) -> DataFrame:
    """A row per document (its digest) and a row per message (owner not null)."""
    owners = task_count(rows.count(), HASHES_PER_OWNER, at_least=8)
    slice_size = -(-(1 << BITS) // owners)
    ddl = "doc_id long, tid long, sha binary, sender long, owner int, n int, k int, unary binary, remainders binary, counts binary, ids binary, null_ids binary"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("tid", pa.int64()), ("sha", pa.binary()), ("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32())]
        + [(c, pa.binary()) for c in ("unary", "remainders", "counts", "ids", "null_ids")]
    )

    def messages(sender: int, marks: np.ndarray, ids: np.ndarray, nulls: np.ndarray):
        order = np.argsort(marks, kind="stable")
        marks, ids, nulls = marks[order], ids[order], nulls[order]
        distinct, first, counts = np.unique(marks, return_index=True, return_counts=True)
        cuts = np.searchsorted(distinct, np.arange(owners + 1, dtype=np.uint64) * np.uint64(slice_size))
        out = []
        for owner in range(owners):
            a, b = cuts[owner], cuts[owner + 1]
            if a < b:
                lo, hi = first[a], first[b - 1] + counts[b - 1]
                k, unary, remainders = rice_encode(distinct[a:b] - np.uint64(owner * slice_size), slice_size)
                held = counts[a:b].astype("<u4").tobytes(), ids[lo:hi].astype("<i8").tobytes(), np.packbits(nulls[lo:hi]).tobytes()
                out.append((None, None, None, sender, owner, int(b - a), k, unary, remainders, *held))
        return record_batch(dict(zip(schema.names, zip(*out))), schema)

    def run(batches):
        held, size, sent = [], 0, 0
        for batch in chunks(batches):
            shas = [hashlib.sha256(normalise(t)).digest() for t in batch.column("text").to_pylist()]
            n, ids = len(shas), batch.column("doc_id")
            yield record_batch(
                {"doc_id": ids, "tid": batch.column("tid"), "sha": shas}
                | {c: pa.nulls(n, schema.field(c).type) for c in schema.names[3:]},
                schema,
            )
            heads = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64) >> np.uint64(64 - BITS)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            held.append((heads, ids.fill_null(0).to_numpy(zero_copy_only=False), nulls))
            size += n
            if size >= ROWS_PER_MESSAGE:
                yield messages((TaskContext.get().partitionId() << 20) + sent, *map(np.concatenate, zip(*held)))
                held, size, sent = [], 0, sent + 1
        if size:
            yield messages((TaskContext.get().partitionId() << 20) + sent, *map(np.concatenate, zip(*held)))

    read = rows.select("doc_id", text_number(F.col("text")).alias("tid"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(run, ddl)


def _suspects(staged: DataFrame) -> DataFrame:
    """``doc_id`` of every document whose fingerprint another row has too."""
    sent = staged.filter("owner IS NOT NULL")

    def answer(group: pa.Table) -> pa.Table:
        sets = [
            rice_decode(m["n"], m["k"], m["unary"], m["remainders"])
            for m in group.select(["n", "k", "unary", "remainders"]).to_pylist()
        ]
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.split(counts[inverse] > 1, np.cumsum([len(s) for s in sets])[:-1])
        return group.select(["sender", "owner"]).append_column(
            "bitmap", pa.array([np.packbits(s).tobytes() for s in shared], pa.binary())
        )

    bitmaps = (
        sent.select("sender", "owner", "n", "k", "unary", "remainders")
        .groupBy("owner")
        .applyInArrow(answer, "sender long, owner int, bitmap binary")
    )
    schema = pa.schema([("doc_id", pa.int64())])

    def read(batches):
        for batch in batches:
            for m in batch.to_pylist():
                counts = np.frombuffer(m["counts"], "<u4")
                shared = np.unpackbits(np.frombuffer(m["bitmap"], np.uint8))[: m["n"]].astype(bool)
                suspect = np.repeat(shared | (counts > 1), counts)
                nulls = np.unpackbits(np.frombuffer(m["null_ids"], np.uint8))[: len(suspect)].astype(bool)
                ids = pa.array(np.frombuffer(m["ids"], "<i8")[suspect], mask=nulls[suspect])
                yield record_batch({"doc_id": ids}, schema)

    return (
        sent.select("sender", "owner", "n", "counts", "ids", "null_ids")
        .join(bitmaps, ["sender", "owner"])
        .select("n", "counts", "ids", "null_ids", "bitmap")
        .mapInArrow(read, "doc_id long")
        .distinct()
    )


def _verify(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """``(sha, keep_id, group_size)`` of every text that occurs more than once."""
    suspects = stage(suspects.withColumnRenamed("doc_id", "_suspect"), "suspects")
    lowered = semi_reduce(rows, "doc_id", suspects, "_suspect").join(
        suspects, F.col("doc_id").eqNullSafe(F.col("_suspect")), "left_semi"
    )
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def lower(batches):
        for batch in chunks(batches):
            texts = [normalise(t) for t in batch.column("text").to_pylist()]
            yield record_batch({"doc_id": batch.column("doc_id"), "text": texts}, schema)

    same_bytes = (
        lowered.select("doc_id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(lower, "doc_id long, text binary")
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return same_bytes.filter("group_size > 1").select(
        F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"
    )
