"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import forget_finished, stage


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: every node with an edge, and the smallest id it reaches.

    Alternates two steps on edges ``(a, b)`` with ``b < a``: every node links its larger
    neighbours, then its smaller ones, to the smallest node it knows of, until stars are
    left. Edges stay linear in number, and each round is written, so a lost executor
    repeats one round at most. A node with very many neighbours only adds rows to a
    minimum that folds before the shuffle and to a join that may be split.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    current, before = stage(ordered.distinct(), "edges"), None
    while True:
        if before is None and current.isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        lowest = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        current = stage(smaller.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        forget_finished(current.sparkSession)
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
