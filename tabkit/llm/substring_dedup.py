"""Substring duplicates: windows of words that an earlier document holds.

Consecutive windows that share a minimiser travel as one packed string to its bucket,
where sorting finds for each window the smallest doc_id in which it starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.llm.frames import chunks, record_batch, split_by_key, text_number, unused
from tabkit.llm.windows import (
    HEAVY_KEY,
    MARKS_SCHEMA,
    Rule,
    Windows,
    covered,
    identified,
    real_id,
    repeated,
    runs_of,
    split_words,
    with_runs,
    word_spans,
)
from tabkit.session import stage

GRAM = 5


def earliest_in_bucket(window: int):
    """For each distinct fragment the smallest id of each of its windows."""

    def run(group: pa.Table) -> pa.Table:
        fragments = group.column("fragment").to_pylist()
        windows, counts = [], []
        for fragment in fragments:
            ends = [i for i, b in enumerate(fragment) if b == 0x20] + [len(fragment)]
            starts = [0] + [i + 1 for i in ends[:-1]]
            made = [fragment[a:b] for a, b in zip(starts, ends[window - 1 :])]
            windows += made
            counts.append(len(made))
        codes = pc.dictionary_encode(pa.array(windows, pa.large_binary())).indices.to_numpy()
        low, high = (np.repeat(group.column(c).to_numpy(), counts) for c in ("low", "high"))
        # Sorted by window, then id: the first of each run holds its smallest id.
        order = np.lexsort((low, codes))
        first = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
        least = np.empty(len(codes), np.int64)
        least[order] = low[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        ends = np.cumsum(counts)
        repeats = least < high
        useful = np.add.reduceat(repeats, ends - counts, dtype=np.int64) > 0
        marks = [runs_of(least[e - n : e], repeats[e - n : e]) for e, n, u in zip(ends, counts, useful) if u]
        kept = group.select(["key", "digest"]).filter(pa.array(useful))
        return kept.append_column("marks", pa.array(marks, MARKS_SCHEMA.field("marks").type)).cast(MARKS_SCHEMA)

    return run


def earliest_across_tasks(window: int):
    """The same for keys too heavy for one bucket: a group by the windows themselves."""

    def run(folded: DataFrame) -> DataFrame:
        words = F.split(F.col("fragment").cast("string"), " ")
        each = folded.select("key", "digest", "low", "high", words.alias("w")).select(
            "key",
            "digest",
            "low",
            "high",
            F.posexplode(
                F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, window)))
            ).alias("at", "text"),
        )
        least = each.groupBy("key", "text").agg(F.min("low").alias("least"))
        one = F.struct(F.col("at").alias("from"), (F.col("at") + 1).alias("to"), "least")
        return (
            each.join(least, ["key", "text"])
            .filter("least < high")
            .groupBy("key", "digest")
            .agg(F.collect_list(one).alias("marks"))
        )

    return run


def repeated_words(
    docs: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy_key: int = HEAVY_KEY,
) -> DataFrame:
    """``(doc_id, tid, runs)``, see ``windows.repeated``: the ranges of windows that
    start in a document of smaller id too."""
    windows = Windows(window, min(GRAM, window), words=True)
    rule = Rule(True, earliest_in_bucket(window), earliest_across_tasks(window))
    return repeated(identified(docs, id_col, text_col), windows, rule, heavy_key)


def _read(rows: DataFrame, make, ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches):
        for batch in chunks(batches):
            made = [make(r) for r in batch.to_pylist()]
            yield record_batch({f.name: [m[f.name] for m in made] for f in schema}, schema)

    return rows.mapInArrow(run, ddl)


def digests(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per document.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged; null text has
    none. A word goes if a window of ``window`` words that covers it also starts in a
    document of smaller doc_id, judged on the input. A null doc_id is the smallest;
    rows that repeat a doc_id never remove words from each other. Texts shorter than a
    window lose nothing. Extra columns are ignored; an empty table gives none.
    """

    rows = identified(docs, id_col, text_col)
    key = [("doc_id", pa.int64()), ("tid", pa.int64())]

    def whole(row):
        words = split_words(row["text"])
        sha = hashlib.sha256(b" ".join(words)).hexdigest()
        return {"doc_id": row["doc_id"], "tid": row["tid"], "n_words": len(words), "whole_sha256": sha}

    def cut(row):
        words = split_words(row["text"])
        gone = covered(len(words), window, row["runs"])
        kept = b" ".join([w for w, g in zip(words, gone) if not g])
        made = {"n_removed": int(gone.sum()), "left_sha256": hashlib.sha256(kept).hexdigest()}
        return {"doc_id": row["doc_id"], "tid": row["tid"], **made}

    everything = _read(
        rows, whole, "doc_id long, tid long, n_words long, whole_sha256 string",
        pa.schema([*key, ("n_words", pa.int64()), ("whole_sha256", pa.string())]),
    )
    changed = _read(
        with_runs(rows, repeated_words(docs, window, id_col, text_col, heavy_key)), cut,
        "doc_id long, tid long, n_removed long, left_sha256 string",
        pa.schema([*key, ("n_removed", pa.int64()), ("left_sha256", pa.string())]),
    )
    return everything.join(changed.distinct(), ["doc_id", "tid"], "left").select(
        real_id("doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, tid, text, removed)`` of the documents that lose words: the text that
    is left, white space between kept words as it was, and the byte spans cut out."""

    def make(row):
        text = row["text"]
        starts, ends = word_spans(np.frombuffer(text, np.uint8))
        gone = covered(len(starts), window, row["runs"])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        # A run goes with the white space behind it, at the end with that before it.
        spans = [
            (int(starts[a]), int(starts[b])) if b < len(starts) else (int(ends[a - 1]) if a else 0, len(text))
            for a, b in edges.reshape(-1, 2)
        ]
        kept, at = [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        return {
            "doc_id": row["doc_id"],
            "tid": row["tid"],
            "text": b"".join(kept).decode("utf-8"),
            "removed": [{"start": a, "end": b} for a, b in spans],
        }

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("text", pa.string()), ("removed", pa.list_(span))])
    found = repeated_words(docs, window, id_col, text_col, heavy_key)
    rows = with_runs(identified(docs, id_col, text_col), found)
    made = _read(rows, make, "doc_id long, tid long, text string, removed array<struct<start: long, end: long>>", schema)
    return made.withColumn("doc_id", real_id("doc_id"))


def dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut from its texts; all rows and columns stay."""
    gone, number, left = unused(docs.columns, "_changed", "_tid", "_left")
    changed = cleaned(docs, window, id_col, text_col).select(
        F.col("doc_id").alias(gone), F.col("tid").alias(number), F.col("text").alias(left)
    )
    # Staged: made once for the bitmap and the join. Rows that repeat are one change.
    changed = stage(changed.dropDuplicates([gone, number]), "changed")
    unsure, clear = split_by_key(docs, docs[id_col].cast("long"), changed, gone)
    whole = F.col(quoted(text_col))
    same = F.col(quoted(id_col)).cast("long").eqNullSafe(F.col(gone)) & (
        text_number(F.coalesce(whole.cast("string"), F.lit(""))) == F.col(number)
    )
    cut = unsure.join(changed, same, "left").select(
        *[(F.coalesce(F.col(left), whole) if c == text_col else F.col(quoted(c))).alias(c) for c in docs.columns]
    )
    return clear.unionByName(cut)
