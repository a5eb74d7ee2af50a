"""Codes for vectors: a codebook for each part, and a GNAT over its entries.

Vectors become integers and are cut into equal parts; each part has a codebook of 64
entries, which is fitted in two rounds over all vectors. The nearest entry is found by a
geometric near-neighbour access tree: a node holds split points, every other entry of
the node belongs to its nearest split point, and for each pair of split point and child
the node stores the least and largest distance between them. A query measures its
distances to the split points; by the triangle inequality these bound its distance to
every entry of a child from below, and a child whose bound is *strictly* above the best
distance so far is left out whole. Bounds are rounded outwards, so rounding never removes
a nearest entry, and distances themselves are compared as integers, so ties go to the
lower index.

The codebooks (16 x 64 entries) are all that is broadcast; a task returns one sum for
each part, entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.llm.frames import chunks, record_batch
from tabkit.session import stage

#: Split points of a node, and entries up to which a child is compared one by one.
SPLITS, BUCKET = 8, 4
#: Integers end here, so that distances of up to 8192 components fit 64 bits.
LARGEST = 1 << 24
#: A label is hot above this share of the rows; so fewer labels than that are.
HOT_SHARE = 1000
FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Node:
    """``splits`` are entry numbers; ``low`` and ``high`` hold, for each split point and
    child, distances rounded down and up. A child may be None."""

    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def root_below(squares: np.ndarray) -> np.ndarray:
    """At most the square root; both the conversion and the root may round."""
    return np.maximum(0, down(np.sqrt(np.maximum(0, down(squares.astype(np.float64))))))


def root_above(squares: np.ndarray) -> np.ndarray:
    return up(np.sqrt(up(squares.astype(np.float64))))


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Integer squared distances of all points to all others."""
    out = np.zeros((len(points), len(others)), np.int64)
    for d in range(points.shape[1]):
        gap = points[:, d, None] - others[None, :, d]
        out += gap * gap
    return out


def build(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The tree over ``entries``. Split points are chosen far from each other, the first
    being the lowest entry; equal entries stay together."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= SPLITS + BUCKET:
        return Node(members, np.zeros((0, 0)), np.zeros((0, 0)), [])
    between = squared(entries[members], entries[members])
    chosen = [0]
    nearest = between[0].copy()
    while len(chosen) < SPLITS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, between[chosen[-1]])
    if len(chosen) == 1:  # all are equal
        return Node(members, np.zeros((0, 0)), np.zeros((0, 0)), [])
    splits = np.array(chosen)
    owner = between[splits].argmin(axis=0)
    owner[splits] = -1
    low, high = np.zeros((len(splits), len(splits))), np.zeros((len(splits), len(splits)))
    children = []
    for j in range(len(splits)):
        inside = np.flatnonzero(owner == j)
        children.append(build(entries, members[inside]) if len(inside) else None)
        if len(inside):
            reach = between[np.ix_(splits, inside)]
            low[:, j], high[:, j] = root_below(reach.min(axis=1)), root_above(reach.max(axis=1))
    return Node(members[splits], low, high, children)


def nearest_entries(points: np.ndarray, entries: np.ndarray, tree: Node, visits: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest entry, the lower one of ties, and the squared distance.
    ``visits`` collects how many distances were measured."""
    best, at = np.full(len(points), FAR, np.int64), np.full(len(points), len(entries), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        distances = squared(points[rows], entries[node.splits])
        if visits is not None:
            visits.append(distances.size)
        for column, entry in enumerate(node.splits):
            d = distances[:, column]
            better = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], entry
        if not node.children:
            return
        below, above = root_below(distances), root_above(distances)
        home = distances.argmin(axis=1)
        # First the child of the nearest split point, which brings the best distance down.
        for own in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                mine = np.flatnonzero((home == j) == own)
                bound = np.maximum(down(below[mine] - node.high[:, j]), down(node.low[:, j] - above[mine])).max(axis=1)
                stay = mine[~(bound > root_above(best[rows[mine]]))]
                if len(stay):
                    visit(child, rows[stay])

    if len(points) and len(entries):
        visit(tree, np.arange(len(points)))
    return at, best


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``, filled up with zeros to ``width``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, and how vectors become integers."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def trees(self) -> list[Node]:
        return [build(e) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def encode(self, vectors: pa.Array, trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Part after part: the integers, their entry and squared distance."""
        values = integers(vectors, self.width, self.scale)
        size = self.entries.shape[2]
        for part, tree in enumerate(trees):
            points = values[:, part * size : (part + 1) * size]
            yield points, *nearest_entries(points, self.entries[part], tree)


def usable(vectors: DataFrame, vector_col: str):
    """Whether a vector takes part: neither null nor with null or non-finite components."""
    v = vectors[quoted(vector_col)]
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return v.isNotNull() & finite


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of ``rows (vec_id, vector)``: they start as the vectors of smallest id,
    and each round replaces every entry by the floored mean of the vectors it is nearest
    to; unused entries stay."""
    width = rows.agg(F.max(F.size("vector")).alias("w")).first()["w"] or 0
    size = -(-max(1, width) // parts)
    # Ids first, then the vectors themselves, for rows that repeat an id.
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), size * parts, scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, size).transpose(1, 0, 2)), scale)
    for _ in range(rounds if len(first) else 0):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    parts, entries, size = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        trees = own.trees()
        totals, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in chunks(batches, 1 << 20):
            for part, (points, at, _) in enumerate(own.encode(batch.column("vector"), trees)):
                np.add.at(totals[part], at, points)
                counts[part] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(counts)
        columns = {
            "part": np.repeat(part, size),
            "entry": np.repeat(entry, size),
            "position": np.tile(np.arange(size), len(part)),
            "total": totals[part, entry].ravel(),
            "n": np.repeat(counts[part, entry], size),
        }
        yield record_batch(columns, schema)

    sums = rows.select("vector").mapInArrow(assign, "part int, entry int, position int, total long, n long")
    moved = books.entries.copy()
    # One row for each component of the codebooks, however many vectors there are.
    for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    shared.unpersist()
    return Codebooks(moved, books.scale)


def codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for every row whose vector
    is neither null nor holds null or non-finite components.

    A component becomes ``floor(scale * x)``, held at 2**24 either way. Vectors shorter
    than the longest, and a length that the parts do not divide, are filled up with zeros,
    so an empty vector is all zeros. Codebooks start as the rows of smallest id (null is
    the largest; rows of one id by their vectors) and may have fewer than ``entries``.
    ``code`` has two hex digits for each part (as many as the largest index needs beyond
    256 entries); ``error`` is the squared distance over all parts, ``label_error`` the sum
    of it over rows of equal label, nulls together (null if it leaves 64 bits). Rows that
    repeat an id each count. Extra columns are ignored; an empty table gives no rows.
    """
    rows = vectors.filter(usable(vectors, vector_col)).select(
        vectors[quoted(id_col)].cast("long").alias("vec_id"),
        vectors[quoted(vector_col)].cast("array<double>").alias("vector"),
        vectors[quoted(label_col)].alias("label"),
    )
    books = fit(rows, parts, entries, rounds, scale)
    coded = stage(_coded(rows, books), "codes")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.digest()))


def _coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(0, books.entries.shape[1] - 1):x}"))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        trees = own.trees()
        names = np.array([f"{i:0{digits}x}" for i in range(own.entries.shape[1])], dtype=object)
        for batch in chunks(batches, 1 << 20):
            texts, error = np.full(batch.num_rows, "", dtype=object), np.zeros(batch.num_rows, np.int64)
            for _, at, distance in own.encode(batch.column("vector"), trees):
                texts, error = texts + names[at], error + distance
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Errors of a label are summed map-side first. Totals of hot labels, fewer than
    ``HOT_SHARE`` by their definition, are broadcast; the other labels are joined by key,
    where none has more than that share of the rows."""
    totals = stage(
        coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors"
    )
    count = totals.agg(F.sum("_n").alias("n")).first()["n"] or 0
    named = totals.select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_hot"), "_n")
    hot = named.filter(F.col("_n") * HOT_SHARE > count).drop("_n")
    others = named.filter(F.col("_n") * HOT_SHARE <= count).drop("_n", "_hot")
    same = F.col("label").eqNullSafe(F.col("_label"))
    marked = coded.join(F.broadcast(hot), same, "left").drop("_label")
    out = ["vec_id", "code", "error", "label_error"]
    quick = marked.filter(F.col("_hot")).select(*out)
    slow = marked.filter(F.col("_hot").isNull()).drop("label_error").join(others, same).select(*out)
    return quick.unionByName(slow)
