"""Positions in ordered groups, without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.text import normalise_text, quoted
from tabkit.session import stage


# Up to this many rows Spark limits groups before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    position: str = "position",
    group_size: str = "group_size",
    weight: str | None = None,
    weight_before: str = "weight_before",
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group's size.

    ``row_number`` would sort a whole group in one task. Here rows are range
    partitioned by group *and* order, so that a large group spans many slices; each
    slice is numbered on its own and shifted by the rows of the slices before it.
    Meant for few, large groups: the offsets have one row per group and slice.

    The numbered rows are written once, because offsets and rows must agree on the
    slice limits, which sampling would otherwise draw anew for each use.

    With ``weight``, also the total weight of the rows before each row in its group.
    """
    names, by, order_by = list(by), [quoted(c) for c in by], [quoted(c) for c in order_by]
    numbered = (
        df.repartitionByRange(*by, *order_by)
        .sortWithinPartitions(*by, *order_by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", 33))
    )
    numbered = stage(numbered, "position")

    measures = [F.min("_at").alias("_start"), F.count("*").alias("_n")]
    if weight:
        measures.append(F.sum(quoted(weight)).alias("_w"))
    runs = numbered.groupBy(*by, "_slice").agg(*measures)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(quoted(c)).alias(f"_run {c}") for c in [*names, "_slice"]],
        (F.col("_start") - F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - 1).alias("_shift"),
        F.sum("_n").over(whole).alias(group_size),
        *([F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w_before")] if weight else []),
    )

    # Staged, so that Catalyst knows their size and need not shuffle the rows for them.
    runs = stage(runs, "offsets")
    rows = numbered
    if weight:
        inside = (
            Window.partitionBy(*by, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        )
        rows = rows.withColumn("_w_inside", F.coalesce(F.sum(quoted(weight)).over(inside), F.lit(0)))
    # The group columns may hold null, which an ordinary equality would lose.
    same = [F.col(quoted(c)).eqNullSafe(F.col(quoted(f"_run {c}"))) for c in [*names, "_slice"]]
    return rows.join(runs, same).select(
        *[quoted(c) for c in df.columns],
        (F.col("_at") - F.col("_shift")).alias(position),
        group_size,
        *([(F.col("_w_inside") + F.col("_w_before")).alias(weight_before)] if weight else []),
    )


def first_n_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``row_in_group``; 0 keeps all rows.

    Spark turns the filter into a window group limit that runs before the shuffle, so
    a task passes on at most ``n`` rows per group however large the group is. It does so
    for small ``n`` only; above, rows get their positions by slices.
    """
    if not 0 < n <= GROUP_LIMIT:
        placed = with_position(df, by, order_by, "row_in_group").drop("group_size")
        return placed.filter(F.col("row_in_group") <= n) if n else placed
    order = Window.partitionBy(*[quoted(c) for c in by]).orderBy(*[quoted(c) for c in order_by])
    return df.withColumn("row_in_group", F.row_number().over(order)).filter(F.col("row_in_group") <= n)


def first_seen_order(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Keys, as groups have them, in the order of their first row:
    ``(key, first_seen, position)``."""
    names = normalise_text(F.col(quoted(key))).alias("_key")
    first = df.groupBy(names).agg(F.min(order_key(order_by)).alias("first_seen"))
    placed = with_position(first, [], ["first_seen", "_key"])
    return placed.select(F.col("_key").alias(key), "first_seen", "position")


def order_key(order_by: Sequence[str]):
    """One sortable column. A single column stays bare, so that min() of a number can
    use a hash aggregate."""
    names = [quoted(c) for c in order_by]
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def preview(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows; 0 keeps all rows."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n) if n > 0 else df
