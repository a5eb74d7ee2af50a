"""Shards by a k-d tree: split at weighted medians until leaves reach the target bytes.

A node is split along its widest dimension at the place that halves its bytes. Rows
are never sorted or moved for it: all nodes of a level narrow their medians down
together by histograms of a fixed number of bins, which the tasks sum up before the
shuffle. Equal coordinates are told apart by a hash of the text and then the id, so
one value that a third of all rows share is split as well, and equal texts, whose
coordinates are equal, stay together unless a median falls right on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.operators.ranking import with_position
from tabkit.session import stage

#: Bins of one histogram, and the share of a node's bytes by which a cut may be off.
BINS = 2048
SLACK = 1 / 2000


@dataclass
class Split:
    """The search for the cut of one node: row keys above it go to the right child.

    ``prefix`` holds the leading key columns found to be equal, ``low`` and ``high`` the
    range of the column that is being narrowed down."""

    node: int
    keys: list[str]
    total: int
    want: float
    low: int
    high: int
    prefix: list[int] = field(default_factory=list)
    before: int = 0
    cut: int | None = None

    @property
    def column(self) -> str:
        return self.keys[len(self.prefix)]

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))


def text_coordinate(text: Column) -> Column:
    """A coordinate in the order of the first seven bytes of a string."""
    return F.conv(F.rpad(F.substring(F.hex(text), 1, 14), 14, "0"), 16, 10).cast("long")


def kd_shards(
    docs: DataFrame,
    size: Column,
    dimensions: dict[str, Column],
    tie: Column,
    identity: Column,
    target_bytes: int | None = None,
    shards: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` plus ``size``, ``shard`` and ``slot`` (replacing such).

    Names are compared without case; columns of any other name stay as they are.
    Leaves are halved until none is above ``target_bytes``, or into ``shards`` leaves.
    ``size`` null counts as 0, a null coordinate as the smallest. Equal rows are told
    apart at random. ``slot`` numbers the rows of a shard gapless from 0, in key order.
    An empty table gives an empty one.
    """
    names = [f"_d{i}" for i in range(len(dimensions))]
    taken = {"size", "shard", "slot"}
    kept = [c for c in docs.columns if c.lower() not in taken]
    # Numbered meanwhile, so that no name meets one of ours.
    thin = docs.select(
        *[F.col(quoted(c)).alias(f"user {i}") for i, c in enumerate(kept)],
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        *[F.coalesce(c.cast("long"), F.lit(-(1 << 62))).alias(n) for n, c in zip(names, dimensions.values())],
        tie.cast("long").alias("_tie"),
        F.coalesce(identity.cast("long"), F.lit(-(1 << 62))).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = stage(thin, "shard-keys").withColumn("_node", F.lit(1).cast("long"))
    leaves = _grow(rows, names, target_bytes, shards)
    for level in leaves["levels"]:
        rows = _descend(rows, level)
    numbers = {node: i for i, node in enumerate(leaves["leaves"])}
    spark = docs.sparkSession
    shard_of = spark.createDataFrame(list(numbers.items()) or [(1, 0)], "_node long, shard int")
    placed = rows.join(F.broadcast(shard_of), "_node").drop("_node")
    ordered = with_position(placed, ["shard"], [*names, "_tie", "_id", "_row"], "_position", "_in_shard")
    back = [F.col(f"`user {i}`").alias(c) for i, c in enumerate(kept)]
    return ordered.select(*back, "size", "shard", (F.col("_position") - 1).alias("slot"))


def _grow(rows: DataFrame, names: Sequence[str], target_bytes: int | None, shards: int | None) -> dict:
    """Levels of splits and the final leaves. What comes to the driver is one line per
    node and histogram bin; the number of nodes is total bytes over target bytes."""
    wanted = {1: shards} if shards else {}
    levels, leaves, active, root = [], [], [1], None
    while active:
        stats = {r["_node"]: r for r in _stats(rows, names)}
        root = root or next(iter(stats.values()), None)
        splits = []
        for node in active:
            s = stats.get(node)
            parts = wanted.get(node, 1) if shards else (2 if s and s["_bytes"] > target_bytes and s["_rows"] > 1 else 1)
            if parts == 1 or not s:
                leaves.append(node)
                if s and parts > 1:
                    leaves.append(node)
                continue
            widest = max(names, key=lambda n: (s[f"hi{n}"] - s[f"lo{n}"]) / max(1, root[f"hi{n}"] - root[f"lo{n}"]))
            left = -(-parts // 2)
            if shards:
                wanted[2 * node], wanted[2 * node + 1] = left, parts - left
            share = left / parts if shards else 0.5
            splits.append(Split(node, [widest, "_tie", "_id", "_row"], s["_bytes"], s["_bytes"] * share, s[f"lo{widest}"], s[f"hi{widest}"]))
        if not splits:
            break
        _find_cuts(rows, splits)
        levels.append(splits)
        rows = _descend(rows, splits)
        active = [child for s in splits for child in (2 * s.node, 2 * s.node + 1)]
    return {"levels": levels, "leaves": sorted(set(leaves), key=lambda n: bin(n)[3:])}


def _stats(rows: DataFrame, names: Sequence[str]) -> list:
    return rows.groupBy("_node").agg(
        F.sum("size").alias("_bytes"),
        F.count("*").alias("_rows"),
        *[F.min(n).alias(f"lo{n}") for n in names],
        *[F.max(n).alias(f"hi{n}") for n in names],
    ).collect()


def _find_cuts(rows: DataFrame, splits: list[Split]) -> None:
    """Narrow all cuts of a level down together, one histogram of each at a time."""
    spark = rows.sparkSession
    while todo := [s for s in splits if s.cut is None]:
        asked = [(s.node, s.column, s.low, s.high, s.width, s.prefix + [None] * (3 - len(s.prefix)), s.keys[0]) for s in todo]
        asks = spark.createDataFrame(
            [(n, k, c, lo, hi, w, *p) for n, c, lo, hi, w, p, k in asked],
            "_node long, _k string, _c string, _lo long, _hi long, _w long, _p0 long, _p1 long, _p2 long",
        )
        first = F.coalesce(*[F.when(F.col("_k") == n, F.col(n)) for n in rows.columns if n.startswith("_d")])
        value = F.when(F.col("_c") == "_tie", F.col("_tie")).when(F.col("_c") == "_id", F.col("_id")).when(F.col("_c") == "_row", F.col("_row")).otherwise(first)
        inside = (
            (F.col("_p0").isNull() | (first == F.col("_p0")))
            & (F.col("_p1").isNull() | (F.col("_tie") == F.col("_p1")))
            & (F.col("_p2").isNull() | (F.col("_id") == F.col("_p2")))
        )
        # Differences of 64-bit keys need more room than 64 bits.
        bin_of = F.floor((value.cast("decimal(20,0)") - F.col("_lo")) / F.col("_w")).cast("long")
        bins = (
            rows.join(F.broadcast(asks), "_node")
            .filter(inside & value.between(F.col("_lo"), F.col("_hi")))
            .groupBy("_node", bin_of.alias("_bin"))
            .agg(F.sum("size").alias("_bytes"), F.min(value).alias("_min"), F.max(value).alias("_max"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for b in bins:
            by_node.setdefault(b["_node"], []).append(b)
        for s in todo:
            _narrow(s, sorted(by_node[s.node], key=lambda b: b["_bin"]))


def _narrow(s: Split, bins: list) -> None:
    before = s.before
    for b in bins:
        if before + b["_bytes"] > s.want or b is bins[-1]:
            break
        before += b["_bytes"]
    left, right = s.want - before, before + b["_bytes"] - s.want
    done = b["_bytes"] <= SLACK * s.total or s.column == "_row" and b["_min"] == b["_max"]
    if done:
        # The whole bin goes to the nearer side.
        s.cut = b["_max"] if right <= left else b["_min"] - 1
    elif b["_min"] == b["_max"]:
        s.prefix.append(b["_min"])
        s.before, s.low, s.high = before, -(1 << 63), (1 << 63) - 1
    else:
        s.before, s.low, s.high = before, b["_min"], b["_max"]


def _descend(rows: DataFrame, splits: list[Split]) -> DataFrame:
    """Move rows to the children of their node; nodes without a split stay."""
    spark = rows.sparkSession
    cuts = spark.createDataFrame(
        [(s.node, s.keys[0], *(s.prefix + [s.cut] + [None] * 4)[:4]) for s in splits],
        "_node long, _k string, _c0 long, _c1 long, _c2 long, _c3 long",
    )
    first = F.coalesce(*[F.when(F.col("_k") == n, F.col(n)) for n in rows.columns if n.startswith("_d")])
    keys = [first, F.col("_tie"), F.col("_id"), F.col("_row")]
    # Lexicographic: above the cut at the first key that differs; a shorter cut includes
    # all rows that equal it.
    right = F.lit(False)
    for i in (3, 2, 1, 0):
        c = F.col(f"_c{i}")
        right = F.when(c.isNull(), F.lit(False)).when(keys[i] != c, keys[i] > c).otherwise(right)
    child = F.when(F.col("_k").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + right.cast("long"))
    out = [c for c in rows.columns if c != "_node"]
    return rows.join(F.broadcast(cuts), "_node", "left").select(*[F.col(f"`{c}`") for c in out], child.alias("_node"))
