"""Packing of token sequences: best-fit decreasing with a segment tree.

Documents longer than a window are first cut into full windows and a rest. The pieces
are dealt at random into groups of bounded size, and each group fills its own windows,
the longest piece first, each into the open window with the least room that suffices.
With thousands of pieces a group wastes next to nothing against one global packing,
and no task ever holds more than its share.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.llm.bpe import Encoder, LibraryEncoder, per_worker, read_vocabulary
from tabkit.llm.frames import chunks, record_batch, task_count, texts_by_id, unused
from tabkit.session import stage

#: Pieces per packing task.
PIECES_PER_TASK = 200_000


class Room:
    """Open windows by remaining room, in a segment tree: a node counts the open windows
    below it, so the least sufficient room is found in as many steps as the tree is deep."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._count(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove the tightest open window with room for ``length``: (room, sequence)."""
        counts, node = self.counts, length + self.leaves
        if not counts[node]:
            # Up to the first right sibling that has open windows, then down its left side.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not counts[node]:
                    node += 1
        room = node - self.leaves
        sequence = self.open[room].pop()
        self._count(room, -1)
        return room, sequence

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """``(sequence, offset)`` for pieces given the longest first."""
    room, placed, sequences = Room(window), [], 0
    for length in lengths:
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} tokens does not fit a window of {window}")
        found = room.take(length) if length < window else None
        if found is None:
            left, sequence = window, sequences
            sequences += 1
        else:
            left, sequence = found
        placed.append((sequence, window - left))
        if left > length:
            room.add(left - length, sequence)
    return placed


def pieces(
    docs: DataFrame,
    vocabulary_path: str,
    window: int = 4096,
    end_id: int | None = 2,
    keep_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as token pieces of at most ``window`` ids, full windows first:
    ``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``.

    ``ids`` holds unsigned little-endian 32-bit ids; ``end_id`` closes each document.
    Null text counts as empty. Without an end id an empty document has no piece.
    """
    columns = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if keep_ids:
        columns, ddl = [*columns, ("ids", pa.binary())], ddl + ", ids binary"
    schema = pa.schema(columns)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        encoder = per_worker(packed_encoder, shared.value)
        for batch in chunks(batches):
            rows = []
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), encoder.by_word(batch.column("text").to_pylist())):
                ids = memoryview(b"".join([*words, end]))
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece))
            made = list(zip(*rows)) or [()] * 6
            if keep_ids:
                made[5] = [bytes(p) for p in made[5]]
            yield record_batch({name: made[i] for i, (name, _) in enumerate(columns)}, schema)

    return texts_by_id(docs, id_col, text_col).mapInArrow(run, ddl)


def packed_encoder(vocabulary: str) -> Encoder:
    """A word as the bytes of its ids."""
    return LibraryEncoder(vocabulary, lambda ids: b"".join([i.to_bytes(4, "little") for i in ids]))


def pack(
    cut: DataFrame, window: int = 4096, length_col: str = "length", pieces_per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """All rows and columns of ``cut`` with ``sequence_id`` and ``offset``.

    Offsets in a sequence are gapless from 0. Columns of those names, in any case, are
    replaced, and columns of any other name stay as they are. Rows
    of null or zero length take no room: their sequence is null. A length above the
    window is refused. Equal rows are placed each; an empty table gives an empty one.
    """
    kept = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    number = unused(cut.columns, "_row")[0]
    # Staged: tokens are made once, and the random dealing keeps to fixed row numbers.
    rows = stage(cut.select(*map(quoted, kept), F.monotonically_increasing_id().alias(number)), "pieces")
    sized = F.coalesce(F.col(quoted(length_col)).cast("long"), F.lit(0))
    groups = task_count(rows.count(), pieces_per_task)
    # Only numbers and lengths meet in a group; tokens stay behind and are joined again.
    group_of = F.pmod(F.xxhash64(number), F.lit(groups)).alias("_group")
    dealt = rows.select(F.col(number).alias("_row"), sized.alias("_length"), group_of)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_length", "descending"), ("_row", "ascending")])
        lengths = group.column("_length").to_pylist()
        dealt_to = group.column("_group")[0].as_py()
        placed = best_fit([n for n in lengths if n > 0], window)
        none = [None] * (len(lengths) - len(placed))
        sequences = [(dealt_to << 32) + s for s, _ in placed] + none
        offsets = [o for _, o in placed] + none
        return group.select(["_row"]).append_column("sequence_id", pa.array(sequences, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())
        )

    placed = dealt.groupBy("_group").applyInArrow(place, "_row long, sequence_id long, offset long")
    return rows.join(placed, rows[number] == placed["_row"]).select(
        *[rows[quoted(c)] for c in kept], "sequence_id", "offset"
    )


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, n_tokens)`` with ids padded to the window, from packed pieces
    that kept their ids. A sequence holds one window at most, so its group is bounded."""

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = b"".join(group.column("ids").to_pylist())
        padded = ids + pad_id.to_bytes(4, "little") * (window - len(ids) // 4)
        return pa.table(
            {"sequence_id": group.column("sequence_id")[:1], "ids": pa.array([padded], pa.binary()), "n_tokens": pa.array([len(ids) // 4], pa.int64())}
        )

    rows = packed.filter("sequence_id IS NOT NULL").select("sequence_id", "offset", "ids")
    return rows.groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids binary, n_tokens long")
