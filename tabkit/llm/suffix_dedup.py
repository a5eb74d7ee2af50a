"""Substring duplicates by suffix arrays, built by two-stage sorting.

Fragments of text that may repeat meet in the bucket of their minimiser (see
``windows``). A bucket sorts the suffixes that begin at its windows: those smaller than
their successor directly, the rest by scanning the buckets of first bytes, where each
suffix places the one before it. Neighbours that agree in their first ``window`` bytes
are repeated strings.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.frames import chunks, record_batch
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
    with_runs,
)

GRAM = 64
#: Slices of suffixes that are copied to be sorted, at a time.
SLICES = 1 << 14


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each place whether its suffix is smaller than the next one; the last is not,
    since the end counts as smaller than any byte."""
    steps = np.append(np.sign(np.diff(text.astype(np.int16))), -1)
    told = np.flatnonzero(steps)
    return steps[told[np.searchsorted(told, np.arange(len(text)))]] > 0


def sorted_places(data: bytes, ends: np.ndarray, places: np.ndarray, window: int, depth: int = 0) -> Iterator[int]:
    """The places in the order of the ``window`` bytes from them on (fewer before their
    text's end), ties by place, if they agree in the first ``depth``.

    More than ``SLICES`` places are parted by their next eight bytes, and no more than
    that many copied slices are held at a time.
    """
    if len(places) <= SLICES or depth >= window:
        if depth >= window:
            yield from np.sort(places).tolist()
            return
        stops = np.minimum(places + window, ends[places]).tolist()
        yield from (p for _, p in sorted((data[p + depth : stop], p) for p, stop in zip(places.tolist(), stops)))
        return
    # Behind its end a text goes on with zeros, and of equal words the shorter is first.
    size = np.clip(np.minimum(places + window, ends[places]) - places - depth, 0, 8)
    word, high = np.zeros(len(places), np.uint64), np.frombuffer(data, np.uint8)
    for i in range(8):
        here = np.flatnonzero(size > i)
        word[here] |= high[places[here] + depth + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = np.lexsort((size, word))
    places, word, size = places[order], word[order], size[order]
    edges = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (size[1:] != size[:-1]), [True])))
    at = 0
    while at < len(edges) - 1:
        # Groups that follow each other are sorted together as far as they are small.
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICES, "right")) - 1)
        part = places[edges[at] : edges[to]]
        yield from sorted_places(data, ends, part, window, depth if len(part) <= SLICES else depth + 8)
        at = to


def suffix_places(texts: list[bytes], starts_wanted: list[int], window: int) -> Iterator[int]:
    """Places, in the joined texts, of the suffixes at the first ``starts_wanted`` places
    of each text, sorted by their first ``window`` bytes.

    Two stages: the suffixes smaller than their successor are sorted directly, within
    the bucket of their first byte. Then the buckets are scanned from the smallest byte
    on; a suffix, when its turn comes, puts the one before it behind all that its own
    bucket has so far, if that one is larger than its successor. Each stretch of places
    reaches on to the next directly sorted suffix (or the text's end), from which the
    larger ones before it follow.
    """
    data = b"".join(texts)
    high = np.frombuffer(data, np.uint8)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    scanned = [array("q") for _ in range(256)]
    # 1: a place that is wanted; 2: the place before it follows from it.
    flags, first_stage, base = np.zeros(len(data), np.uint8), [], 0
    for text, wanted in zip(texts, starts_wanted):
        smaller = smaller_than_next(high[base : base + len(text)])
        after = np.flatnonzero(smaller[wanted - 1 :])
        end = wanted + int(after[0]) if len(after) else len(text)
        first_stage.append(np.flatnonzero(smaller[:end]) + base)
        if end == len(text) and not smaller[-1]:
            # The suffix before the end is the smallest of its bucket.
            scanned[text[-1]].append(base + end - 1)
        flags[base : base + wanted] = 1
        flags[base + 1 : base + end] |= (~smaller[: end - 1]).astype(np.uint8) << 1
        base += len(text)
    flags = flags.tobytes()
    direct = np.concatenate(first_stage) if first_stage else np.zeros(0, np.int64)
    direct = direct[np.argsort(high[direct], kind="stable")]
    cuts = np.searchsorted(high[direct], np.arange(257))
    for byte in range(256):
        own = direct[cuts[byte] : cuts[byte + 1]]
        # The scanned places grow while they are read.
        for place in chain(scanned[byte], sorted_places(data, ends, own, window) if len(own) else ()):
            flag = flags[place]
            if flag & 2:
                scanned[data[place - 1]].append(place - 1)
            if flag & 1:
                yield place


def suffix_array(texts: list[bytes], starts_wanted: list[int], window: int) -> list[tuple[int, int]]:
    """``suffix_places`` as ``(text, start)``."""
    bases = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    places = np.fromiter(suffix_places(texts, starts_wanted, window), np.int64)
    numbers = np.searchsorted(bases, places, "right") - 1
    return list(zip(numbers.tolist(), (places - bases[numbers]).tolist()))


def repeated_suffixes(texts: list[bytes], windows: list[int], window: int) -> list[np.ndarray]:
    """For each text, which of its windows occur again in any of the texts: neighbours
    in the suffix array whose common prefix reaches ``window`` bytes."""
    data = b"".join(texts)
    marks = bytearray(len(data))
    previous, before = 0, b""
    for place in suffix_places(texts, windows, window):
        here = data[place : place + window]
        if here == before:
            marks[place] = marks[previous] = 1
        previous, before = place, here
    bases = np.cumsum([0, *map(len, texts)]).tolist()
    found = np.frombuffer(marks, bool)
    return [found[a : a + n] for a, n in zip(bases, windows)]


def repeated_in_bucket(window: int):
    """For each distinct fragment the runs of its repeated windows.

    All windows of a fragment with copies repeat; the others are found by sorting.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("digest", "ascending")])
        keys, copies = group.column("key").to_numpy(), group.column("copies").to_numpy()
        fragments = group.column("fragment")
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        marks: list[list[dict]] = []
        for a, b in zip(edges[:-1], edges[1:]):
            texts = fragments[a:b].to_pylist()
            found = repeated_suffixes(texts, [len(t) - window + 1 for t in texts], window)
            for n, repeats in zip(copies[a:b], found):
                if n > 1:
                    repeats[:] = True
                marks.append(runs_of(np.zeros(len(repeats), np.int64), repeats))
        kept = group.select(["key", "digest"]).append_column("marks", pa.array(marks, MARKS_SCHEMA.field("marks").type))
        return kept.filter(pa.array([len(m) > 0 for m in marks])).cast(MARKS_SCHEMA)

    return run


def repeated_across_tasks(window: int):
    """For keys too heavy for one bucket: count windows by two 64-bit hashes, in a group
    that folds before the shuffle."""
    ddl = "key long, digest long, at int, copies long, one long, two long"
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("copies", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])

    def cut(batches):
        for batch in chunks(batches, 1 << 18):
            out = {n: [] for n in schema.names}
            for r in batch.select(["key", "digest", "copies", "fragment"]).to_pylist():
                text = r["fragment"]
                n = len(text) - window + 1
                for at in range(n):
                    sha = hashlib.blake2b(text[at : at + window], digest_size=16).digest()
                    out["one"].append(int.from_bytes(sha[:8], "little", signed=True))
                    out["two"].append(int.from_bytes(sha[8:], "little", signed=True))
                out["at"] += range(n)
                for c in ("key", "digest", "copies"):
                    out[c] += [r[c]] * n
            yield record_batch(out, schema)

    def run(folded: DataFrame) -> DataFrame:
        each = folded.mapInArrow(cut, ddl)
        many = each.groupBy("one", "two").agg(F.sum("copies").alias("n")).filter("n > 1").select("one", "two")
        one = F.struct(F.col("at").alias("from"), (F.col("at") + 1).alias("to"), F.lit(0).cast("long").alias("least"))
        return each.join(many, ["one", "two"]).groupBy("key", "digest").agg(F.collect_list(one).alias("marks"))

    return run


def repeated_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, tid, runs)``, see ``windows.repeated``: the ranges of byte windows that
    start anywhere else too."""
    windows = Windows(window, min(GRAM, 1 << (window.bit_length() - 1)), words=False)
    rule = Rule(False, repeated_in_bucket(window), repeated_across_tasks(window))
    return repeated(identified(docs, id_col, text_col), windows, rule, heavy_key)


def cleaned(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, tid, removed, kept)`` of the documents that lose bytes; a null id is the
    smallest long here."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.binary())])

    def run(batches):
        for batch in chunks(batches):
            out = {n: [] for n in schema.names}
            for row in batch.to_pylist():
                text = np.frombuffer(row["text"], np.uint8)
                gone = covered(len(text), window, row["runs"])
                spans = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                out["doc_id"].append(row["doc_id"])
                out["tid"].append(row["tid"])
                out["removed"].append([{"start": int(a), "end": int(b)} for a, b in spans])
                out["kept"].append(text[~gone].tobytes())
            yield record_batch(out, schema)

    rows = with_runs(identified(docs, id_col, text_col), repeated_bytes(docs, window, id_col, text_col, heavy_key))
    made = rows.select("doc_id", "tid", "text", "runs").mapInArrow(
        run, "doc_id long, tid long, removed array<struct<start: long, end: long>>, kept binary"
    )
    return made


def dedup(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)`` per document: the maximal byte spans removed
    and the bytes left, which need not be whole characters.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere
    else, in the same document or another, overlaps included, judged on the input.
    Matches never cross documents. Null text counts as empty; rows that repeat a doc_id
    are documents of their own. Extra columns are ignored; an empty table gives none.
    """
    changed = cleaned(docs, window, id_col, text_col, heavy_key).distinct()
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return identified(docs, id_col, text_col).join(changed, ["doc_id", "tid"], "left").select(
        real_id("doc_id").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("kept", "text").alias("kept"),
    )


def digests(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of what ``dedup`` gives.
    Texts that lose nothing are digested where they are read."""
    everything = identified(docs, id_col, text_col).select(
        "doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )
    changed = cleaned(docs, window, id_col, text_col, heavy_key).select(
        "doc_id",
        "tid",
        F.octet_length("kept").cast("long").alias("left"),
        F.size("removed").cast("long").alias("spans"),
        F.sha2("kept", 256).alias("sha"),
    )
    return everything.join(changed.distinct(), ["doc_id", "tid"], "left").select(
        real_id("doc_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
        F.coalesce("spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )
