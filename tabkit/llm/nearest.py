"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by fast pseudo-rotations (random signs and Hadamard
transforms) and names the signed axis nearest to it; several such axes in a row make a
bucket. A query probes in each table the buckets whose axes lie nearest. Buckets larger
than a block are dealt into blocks, each of which answers with its ten nearest by the
exact distance, so neither a block nor an answer grows with a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.frames import record_batch
from tabkit.operators.ranking import first_n_per_group
from tabkit.session import stage

ROWS_PER_BUCKET, BLOCK_ROWS = 400, 4096
#: Queries by which probes are set, and the recall asked of them.
SAMPLE_QUERIES, TARGET_RECALL = 64, 0.97
MOST_PROBES = 256
#: Times the tables, when so many probes do not reach it.
MORE_TABLES = (1, 2, 4)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, by butterflies."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class Tables:
    """``tables`` hash tables whose buckets are ``axes`` signed axes in a row."""

    dimension: int
    tables: int
    axes: int
    seed: int = 7

    @property
    def padded(self) -> int:
        return 1 << max(0, (self.dimension - 1).bit_length())

    def turned(self, vectors: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Closeness to every signed axis after a pseudo-rotation: coordinates, then
        their negatives."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        x = np.zeros((len(unit), self.padded))
        x[:, : self.dimension] = unit
        signs = np.random.default_rng([self.seed, table, axis]).choice([-1.0, 1.0], size=(3, self.padded))
        for s in signs:
            x = hadamard(x * s)
        return np.concatenate([x, -x], axis=1)

    def buckets(self, vectors: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(vectors), np.int64)
        for axis in range(self.axes):
            code = code * 2 * self.padded + self.turned(vectors, table, axis).argmax(axis=1)
        return code

    def probes(self, vectors: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets nearest to each vector, the nearest first (the summed
        loss against the best axes), fewer if there are fewer."""
        codes, loss = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
        for axis in range(self.axes):
            close = self.turned(vectors, table, axis)
            best = np.argsort(-close, axis=1, kind="stable")[:, :count]
            value = np.take_along_axis(close, best, axis=1)
            loss = (loss[:, :, None] + (value[:, :1] - value)[:, None, :]).reshape(len(vectors), -1)
            codes = (codes[:, :, None] * 2 * self.padded + best[:, None, :]).reshape(len(vectors), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :count]
            loss, codes = np.take_along_axis(loss, order, axis=1), np.take_along_axis(codes, order, axis=1)
        return codes


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: not null, not zero, without null or
    non-finite components, of the most frequent length; rows that repeat id and vector
    count once, ids that are null take no part."""
    typed = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")
    ).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        & F.exists("v", lambda x: x != 0)
    )
    lengths = typed.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return typed.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def top(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of a block, ties to smaller ids: (ids, distances)."""
    other = ids != own
    distance = np.sqrt(np.square(vectors[other] - query).sum(axis=1))
    order = np.lexsort((ids[other], distance))[:k]
    return ids[other][order], distance[order]


ANSWER = "query_id long, vec_id long, score double"
ANSWER_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def answers(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> dict:
    out = {"query_id": [], "vec_id": [], "score": []}
    for q, own in zip(queries, query_ids):
        found, distance = top(q, own, vectors, ids, k)
        out["query_id"].append(np.full(len(found), own))
        out["vec_id"].append(found)
        out["score"].append(distance)
    return {n: np.concatenate(x) if x else np.zeros(0) for n, x in out.items()}


def merged(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of a query's block answers; there are a bounded number of them."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded set of queries, which every task gets whole."""
    asked = queries.orderBy("vec_id").toArrow()
    q = queries.sparkSession.sparkContext.broadcast((matrix(asked.column("v")), asked.column("vec_id").to_numpy()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield record_batch(answers(*q.value, matrix(batch.column("v")), batch.column("vec_id").to_numpy(), k), ANSWER_SCHEMA)

    return merged(vectors.mapInArrow(run, ANSWER), k)


def by_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``exact`` for any number of queries, ``BLOCK_ROWS`` or so at a time."""
    queries = stage(queries, "ann-exact")
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = [stage(exact(queries.filter(block == b), vectors, k), "ann-exact-found") for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def fitted(index: Tables, queries: DataFrame, vectors: DataFrame, k: int) -> tuple[Tables, int] | None:
    """Tables, and the least number of probes by which a bounded sample of queries finds
    ``TARGET_RECALL`` of its true neighbours in them.

    If ``MOST_PROBES`` do not reach it, there are up to ``MORE_TABLES`` times the tables,
    then fewer axes. None if nothing reaches it.
    """
    sample = stage(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES), "ann-sample")
    near = exact(sample, vectors, k).select("query_id", F.col("vec_id").alias("near_id"))
    pairs = (
        near.join(sample.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"]), "query_id")
        .join(vectors.select(F.col("vec_id").alias("near_id"), "v").dropDuplicates(["near_id"]), "near_id")
        .select("q", "v")
        .toArrow()
    )
    if not pairs.num_rows:
        return index, 1
    q, v = matrix(pairs.column("q")), matrix(pairs.column("v"))
    last = int(np.ceil(TARGET_RECALL * len(q))) - 1
    for axes in range(index.axes, 0, -1):
        rank, made = np.full(len(q), MOST_PROBES), 0
        for more in MORE_TABLES:
            tried = Tables(index.dimension, more * index.tables, axes, index.seed)
            for table in range(made, tried.tables):
                hit = tried.probes(q, table, MOST_PROBES) == tried.buckets(v, table)[:, None]
                rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
            made, needed = tried.tables, int(np.sort(rank)[last])
            if needed < MOST_PROBES:
                return tried, needed + 1
    return None


def search(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    tables: int = 8,
    probes: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` nearest vectors by
    Euclidean distance, without itself, ties to the smaller id.

    ``queries`` has the columns of ``vectors`` and defaults to the vectors whose id is
    divisible by 100. See ``usable`` for the vectors that take part; a query that does
    not gets no rows. Hashing goes by direction, the final order by the distance of
    the original vectors in double precision. Without ``probes`` their number is fitted
    on a sample of 64 queries, and there are more tables or fewer axes if the sample
    misses the recall asked; if these miss it too, all vectors are compared. Queries
    whose probes give fewer than ``k`` answers are compared with all vectors, whatever
    ``probes``. Extra columns are ignored; empty tables give no rows.
    """
    given = stage(usable(vectors, id_col, vector_col), "ann-vectors")
    asked = given.filter(F.pmod("vec_id", F.lit(100)) == 0) if queries is None else usable(queries, id_col, vector_col)
    asked = asked.dropDuplicates(["vec_id"])
    # Of equal vectors only the k + 1 smallest ids can be among k nearest, whoever asks.
    spread = stage(first_n_per_group(given.distinct(), ["v"], ["vec_id"], k + 1).select("vec_id", "v"), "ann-rows")
    first = spread.select(F.size("v").alias("n")).first()
    if first is None:
        return spread.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, dimension = spread.count(), first["n"]
    index = Tables(dimension, tables, 0)
    axes = 0 if rows <= 2 * ROWS_PER_BUCKET else max(1, round(np.log(rows / ROWS_PER_BUCKET) / np.log(2 * index.padded)))
    index = Tables(dimension, tables if axes else 1, axes)
    if axes and not probes:
        asked = stage(asked, "ann-queries")
        fit = fitted(index, asked, spread, k)
        if fit is None:
            return by_blocks(asked, spread, k)
        index, probes = fit
    probes, whole = probes or 1, asked

    hashed_schema = pa.schema([("table", pa.int32()), ("bucket", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def hashed(count: int | None):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("v"))
                for table in range(index.tables):
                    codes = index.buckets(x, table)[:, None] if count is None else index.probes(x, table, count)
                    for column in codes.T:
                        yield record_batch(
                            {"table": np.full(len(x), table, np.int32), "bucket": column, "vec_id": batch.column("vec_id"), "v": batch.column("v")},
                            hashed_schema,
                        )

        return run

    ddl = "table int, bucket long, vec_id long, v array<double>"
    filed = spread.mapInArrow(hashed(None), ddl)
    sizes = filed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    sizes = stage(sizes, "ann-buckets")
    asked = asked.mapInArrow(hashed(probes), ddl).withColumnsRenamed({"vec_id": "query_id", "v": "q"})
    asked = asked.join(sizes, ["table", "bucket"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    # Only buckets of several blocks need their rows dealt out.
    several = sizes.filter("blocks > 1")
    filed = filed.join(several, ["table", "bucket"], "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("blocks")), F.lit(0))
    )

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return ANSWER_SCHEMA.empty_table()
        found = answers(
            matrix(left.column("q")), left.column("query_id").to_numpy(), matrix(right.column("v")), right.column("vec_id").to_numpy(), k
        )
        return pa.Table.from_batches([record_batch(found, ANSWER_SCHEMA)])

    key = ["table", "bucket", "block"]
    found = (
        asked.select(*key, "query_id", "q").groupBy(*key)
        .cogroup(filed.select(*key, "vec_id", "v").groupBy(*key))
        .applyInArrow(rerank, ANSWER)
    )
    if not index.axes:
        return merged(found, k)
    found = stage(merged(found, k), "ann-found")
    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stage(whole.join(enough, "vec_id", "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    full = found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
    return full.unionByName(by_blocks(short, spread, k))
