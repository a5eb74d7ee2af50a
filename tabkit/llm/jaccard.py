"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is its set of five-word shingles. Equal sets are folded first. A set's
MinHash values fill ``TREES`` tries, each along a path of up to ``DEPTH`` values; sets
that share a path's beginning are candidates. Beginnings are shortened until a pair
right at the threshold is found with the target recall.

Candidates are joined to the head of their trie node, never to each other, and the
connected groups that result are verified exactly: all pairs of a group, in tiles of
bounded size that return link counts per set and a spanning forest, not pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.components import components
from tabkit.llm.frames import chunks, drop_documents, record_batch, semi_reduce, task_count
from tabkit.llm.windows import MULTIPLIER, identified, mix, word_gram_hashes, word_hashes, word_spans
from tabkit.session import stage

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9995
#: Sets in a block of a verified group, and in a task of small groups.
BLOCK_SETS, SETS_PER_TASK = 1000, 2000
#: Shingles whose columns a tile multiplies at once.
COLUMNS = 4096


def expected_recall(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair shares a beginning of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest beginning by which pairs at the threshold reach the target recall."""
    while depth > 1 and expected_recall(threshold, depth, trees) < recall:
        depth -= 1
    return depth


class Forest:
    """MinHash values as trie nodes: one 64-bit path hash per tree at the given depth."""

    def __init__(self, depth: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.factors = rng.integers(1 << 32, size=(trees * depth, 1), dtype=np.uint32) | np.uint32(1)
        self.offsets = rng.integers(1 << 32, size=(trees * depth, 1), dtype=np.uint32)

    def nodes(self, shingles: np.ndarray) -> np.ndarray:
        x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), np.uint32(0xFFFFFFFF))
        for at in range(0, len(x), 1024):
            values = self.factors * x[at : at + 1024]
            values += self.offsets
            least = np.minimum(least, values.min(axis=1))
        least = least.reshape(self.trees, self.depth).astype(np.uint64)
        path = np.arange(self.trees, dtype=np.uint64)
        for level in range(self.depth):
            path = mix(path * MULTIPLIER + least[:, level] + np.uint64(1))
        return path.view(np.int64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``size`` words; a shorter
    text is one run, a text without words has none."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    word_at = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    grams = word_gram_hashes(words, size)
    out = []
    for a, b in zip(word_at[:-1], word_at[1:]):
        own = grams[a : b - size + 1] if b - a >= size else word_gram_hashes(words[a:b], b - a) if b > a else grams[:0]
        out.append(np.unique(own))
    return out


def set_number(shingles: np.ndarray) -> int:
    """A 64-bit number for a set of shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """``(doc_id, class_id, n_links, n_text_links, copies, tid)`` for every row.

    Two documents are linked when the Jaccard similarity of their shingle sets is
    ``threshold`` or more; a class is what links connect, named by its smallest doc_id.
    ``n_links`` counts the other rows linked to this one, copies included,
    ``n_text_links`` the other distinct sets, ``copies`` the rows of the same set.
    Words are runs of bytes other than space and 0x09-0x0D, unchanged. A text without
    words (null, empty, white space) is linked to none. Rows that repeat are copies. A
    null doc_id counts as the smallest. Extra columns are ignored; an empty table gives
    none. ``tid`` is a hash of the text.
    """
    rows = identified(docs, id_col, text_col)
    signed = stage(_signed(rows, size, shortened(threshold)), "signed")
    sets = signed.filter(F.size("nodes") > 0).groupBy("set_id", "nodes").agg(
        F.min("doc_id").alias("head"), F.count("*").alias("copies")
    )
    sets = stage(sets, "sets")
    verified = stage(_verified(rows, sets, _candidates(sets), threshold, size, block_sets), "verified")
    links = verified.groupBy("set_id").agg(F.sum("texts").alias("texts"), F.sum("others").alias("others"))
    classes = components(verified.filter("label <> set_id").select(F.col("set_id").alias("a"), F.col("label").alias("b")))
    named = sets.select("set_id", "head", "copies").join(classes.withColumnRenamed("id", "set_id"), "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id"))
    names = named.groupBy("component").agg(F.min("head").alias("class_id"))
    facts = named.join(names, "component").join(links, "set_id", "left").select("set_id", "class_id", "copies", "texts", "others")
    least = F.lit(-(1 << 63))

    def shown(c):
        return F.when(c != least, c)

    return (
        signed.select("doc_id", "tid", "set_id")
        .join(facts, "set_id", "left")
        .select(
            shown(F.col("doc_id")).alias("doc_id"),
            shown(F.coalesce("class_id", "doc_id")).alias("class_id"),
            (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_text_links"),
            F.coalesce("copies", F.lit(1)).alias("copies"),
            "tid",
        )
    )


def _signed(rows: DataFrame, size: int, depth: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("set_id", pa.int64()), ("nodes", pa.list_(pa.int64()))])

    def run(batches):
        forest = Forest(depth)
        for batch in chunks(batches, 1 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            yield record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "tid": batch.column("tid"),
                    "set_id": [set_number(s) if len(s) else None for s in sets],
                    "nodes": [forest.nodes(s) if len(s) else [] for s in sets],
                },
                schema,
            )

    return rows.mapInArrow(run, "doc_id long, tid long, set_id long, nodes array<long>")


def _candidates(sets: DataFrame) -> DataFrame:
    """``(set_id, group)`` of the sets that share a trie node with another, connected."""
    placed = sets.select("set_id", F.explode("nodes").alias("node"))
    heads = placed.groupBy("node").agg(F.min("set_id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    edges = placed.join(heads.select("node", "b"), "node").select(F.col("set_id").alias("a"), "b")
    return components(edges).select(F.col("id").alias("set_id"), F.col("component").alias("group"))


def _verified(rows: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float, size: int, block_sets: int) -> DataFrame:
    """Per set and tile: links to other sets there, rows behind them, and the smallest
    set it is connected with inside the tile."""
    groups = stage(groups, "groups")
    blocks = groups.groupBy("group").agg(F.ceil(F.count("*") / block_sets).alias("blocks"))
    wanted = groups.join(blocks, "group").join(sets.select("set_id", "head", "copies"), "set_id")
    wanted = stage(wanted, "wanted")
    texts = semi_reduce(rows, "doc_id", wanted, "head").join(wanted, F.col("doc_id") == F.col("head"))
    schema = pa.schema([("group", pa.int64()), ("blocks", pa.int64()), ("set_id", pa.int64()), ("copies", pa.int64()), ("shingles", pa.binary())])

    def shingles(batches):
        for batch in chunks(batches, 1 << 20):
            made = shingle_sets(batch.column("text").to_pylist(), size)
            # A repeated doc_id may hold other texts too.
            own = [i for i, (s, n) in enumerate(zip(made, batch.column("set_id").to_pylist())) if len(s) and set_number(s) == n]
            kept = batch.select(["group", "blocks", "set_id", "copies"]).take(pa.array(own, pa.int64()))
            yield record_batch({c: kept.column(c) for c in kept.schema.names} | {"shingles": [made[i].tobytes() for i in own]}, schema)

    held = texts.select("group", "blocks", "set_id", "copies", "text").mapInArrow(
        shingles, "group long, blocks long, set_id long, copies long, shingles binary"
    )
    tasks = task_count(wanted.filter("blocks = 1").count(), SETS_PER_TASK, at_least=8)
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    tiled = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group",
        "set_id",
        "copies",
        "shingles",
        own.alias("block"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(F.col("group")).alias("_task"),
        (F.col("blocks") > 1).alias("_tiled"),
        F.least(own, "_other").alias("_i"),
        F.greatest(own, "_other").alias("_j"),
    )
    result = pa.schema([("set_id", pa.int64()), ("label", pa.int64()), ("texts", pa.int64()), ("others", pa.int64())])

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("block", "ascending"), ("set_id", "ascending")])
        group, block, ids, copies = (table.column(c).to_numpy() for c in ("group", "block", "set_id", "copies"))
        first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])))
        index = np.flatnonzero(first)
        group, block, ids, copies = group[index], block[index], ids[index], copies[index]
        arrays = [np.frombuffer(table.column("shingles")[int(i)].as_py(), np.uint64) for i in index]
        cross = table.column("_i")[0].as_py() != table.column("_j")[0].as_py()
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        parts = []
        for a, b in zip(edges[:-1], edges[1:]):
            linked = similar(arrays[a:b], threshold)
            if cross:
                linked &= block[a:b, None] != block[None, a:b]
            if linked.any():
                labels = connected(linked, ids[a:b])
                parts.append(np.stack([ids[a:b], labels, linked.sum(axis=1), linked @ copies[a:b]]))
        columns = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
        return pa.table({f.name: pa.array(c, pa.int64()) for f, c in zip(result, columns)}, schema=result)

    return tiled.groupBy("_tiled", "_task", "_i", "_j").applyInArrow(
        tile, "set_id long, label long, texts long, others long"
    )


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of different sets reach the threshold, exactly: products of the
    incidence matrix count the shared shingles, over those that two sets have."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, column, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = frequency > 1
    number = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n))
    total = int(several.sum())
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        incidence = np.zeros((n, min(COLUMNS, total - start)), np.float32)
        incidence[owner[a:b], column[a:b] - start] = 1
        shared += incidence @ incidence.T
    linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def connected(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id each one is connected with."""
    labels = np.arange(len(ids))
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = labels
    labels, reach = rank.copy(), linked | np.eye(len(ids), dtype=bool)
    while True:
        lower = np.where(reach, labels[None, :], len(ids)).min(axis=1)
        lower = np.minimum(lower, labels[order[lower]])
        if (lower == labels).all():
            return ids[order[labels]]
        labels = lower


def dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class, with all columns: one document
    of each class stays, and all that are linked to none. A repeated row stays repeated
    with the document it repeats."""
    found = join(docs, threshold, SHINGLE, id_col, text_col)
    return drop_documents(docs, found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))), id_col, text_col)
