"""Group one table by one key: row count, exact sums, first-seen distinct joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.amounts import (
    AMOUNT_TYPE,
    HALF,
    LIMB_ENTRIES,
    LIMB_TYPE,
    PLACES,
    all_limbs,
    half_sums,
    in_places,
    limbs_of_decimal,
    long_limb,
    no_limb,
    plain_digits,
    plain_number,
    round_text_half_up,
    settled,
    with_parts,
)
from tabkit.functions.text import join_separator, normalise_text, quoted
from tabkit.lookups import ROWS_COLUMN
from tabkit.operators.ranking import order_key, with_position
from tabkit.operators.validate import check_amounts

# About how much text a part of `long_cells` holds.
PART_BYTES = 8 << 20


def group_count(df: DataFrame, key: str, name: str = ROWS_COLUMN) -> DataFrame:
    """Rows per key; the blank key is a group of its own."""
    return df.groupBy(normalise_text(F.col(quoted(key))).alias(key)).agg(F.count("*").alias(name))


def decimal_sum(
    df: DataFrame, key: str, columns: Sequence[str], rows: str | None = None, first: Column | None = None
) -> DataFrame:
    """Exact sum of the valid amounts per key as ``decimal(38,10)``, 0 when there are none.

    Only the total is rounded. One that the type cannot hold fails the job:
    :func:`exact_sum` gives it as text. ``rows`` names an optional row count, and
    ``first`` an expression whose least value per key is added as ``_first``, both from
    the same pass.
    """
    def typed(c: str) -> Column:
        total = F.col(quoted(c))
        message = F.concat(F.lit(f"a total of column {c!r} has more than 28 digits before the point: "), total)
        return F.coalesce(total.try_cast(AMOUNT_TYPE), F.raise_error(message).cast(AMOUNT_TYPE))

    totals = exact_sum(df, key, columns, rows, first)
    return totals.select(*[typed(c).alias(c) if c in columns else F.col(quoted(c)) for c in totals.columns])


def exact_sum(
    df: DataFrame, key: str, columns: Sequence[str], rows: str | None = None, first: Column | None = None
) -> DataFrame:
    """Exact sum of the valid amounts per key as plain text of any width, ``0`` when
    there are none; ``rows`` and ``first`` as in :func:`decimal_sum`.

    Ordinary amounts are summed as decimals. Wider ones are cut into limbs of 18 digits,
    which have columns by their places; what does not fit into these adds a row for every
    limb, summed by key and place. Sums are made per task first, then per key, so neither
    the width of amounts nor their number meets a limit; a key then settles the carries of
    its few places.
    """
    extra = [first.alias("_first")] if first is not None else []
    raw = [f"_raw {i}" for i in range(len(columns))]
    names = [f"_sum {i}" for i in range(len(columns))]
    narrow = df.select(
        normalise_text(F.col(quoted(key))).alias("_key"), *extra, *[F.col(quoted(c)).alias(r) for c, r in zip(columns, raw)]
    )
    parsed = with_parts(narrow, dict(zip(names, raw)))
    slots = {n: [(p, f"{n} at {p}") for p in PLACES] for n in names}
    every = [slot for n in names for _, slot in slots[n]]
    made = [*(["_first"] if extra else []), *map(quoted, names)]
    limbs, outside = [], []
    for i, n in enumerate(names):
        digits, high, sign = (F.col(quoted(f"{n} {c}")) for c in ("digits", "high", "sign"))
        fits = in_places(digits, high)
        limbs += [F.when(fits, long_limb(digits, high, sign, p)).alias(slot) for p, slot in slots[n]]
        outside.append(F.when(~fits, all_limbs(digits, high, sign, i)))
    # An entry without a place stands for all amounts but those outside. The array functions
    # end the generated stage here: as one, it would be larger than what the JVM compiles.
    entries = F.concat(F.array(no_limb()), *[F.coalesce(o, F.array().cast(LIMB_ENTRIES)) for o in outside])
    # With the task a row is in, so that longs are sums of no more rows than a task has. Outer,
    # for otherwise a filter on the entries would move down to the scan and work out all again.
    parsed = parsed.select("_key", *made, *limbs, entries.alias("_entries"))
    parsed = parsed.select("_key", F.spark_partition_id().alias("_task"), *made, *map(quoted, every), F.inline_outer("_entries"))
    halves = [(f"{slot} high", f"{slot} low") for slot in every]
    least = [F.min("_first").alias("_first")] if extra else []
    by_task = parsed.groupBy("_key", "_task", "_column", "_at").agg(
        F.count("*").alias("_rows"),
        *least,
        *[F.sum(quoted(n)).alias(n) for n in names],
        *[c.alias(h) for slot, pair in zip(every, halves) for h, c in zip(pair, half_sums(F.col(quoted(slot))))],
        F.sum("_limb").alias("_limb"),
    )
    is_base = F.col("_column").isNull()

    def of_base(name: str) -> Column:
        return F.when(is_base, F.col(quoted(name)))

    def total(slot: str, pair: tuple[str, str]) -> Column:
        high, low = (F.sum(of_base(h).cast("decimal(19,0)")) for h in pair)
        return (high * F.lit(HALF).cast("decimal(10,0)") + low).cast(LIMB_TYPE).alias(slot)

    own = F.struct(F.col("_at").alias("at"), F.col("_limb").alias("limb"))
    totals = by_task.groupBy("_key").agg(
        F.sum(of_base("_rows")).alias("_rows"),
        *least,
        *[F.coalesce(F.sum(of_base(n)), F.lit(0)).cast(AMOUNT_TYPE).alias(n) for n in names],
        *[total(slot, pair) for slot, pair in zip(every, halves)],
        *[F.collect_list(F.when(F.col("_column") == i, own)).alias(f"{n} limbs") for i, n in enumerate(names)],
    )
    shown = [F.col("_key"), F.col("_rows"), *([F.col("_first")] if extra else [])]
    wide = []
    for n in names:
        placed = F.array(*[F.struct(F.lit(p).alias("at"), F.col(quoted(slot)).alias("limb")) for p, slot in slots[n]])
        limbs = F.concat(F.filter(placed, lambda e: e["limb"].isNotNull()), F.col(quoted(f"{n} limbs")))
        limbs = F.when(F.size(limbs) > 0, F.concat(limbs_of_decimal(F.col(quoted(n))), limbs))
        wide.append(limbs.alias(f"{n} limbs"))
    totals = totals.select(*shown, *map(quoted, names), *wide)
    ways = [settled(F.col(quoted(f"{n} limbs")), sign).alias(f"{n} {sign}") for n in names for sign in (1, -1)]
    totals = totals.select(*shown, *map(quoted, names), *ways)
    results = [
        F.coalesce(plain_number(F.col(quoted(f"{n} 1")), F.col(quoted(f"{n} -1"))), plain_digits(F.col(quoted(n)).cast("string")))
        for n in names
    ]
    counted = [F.col("_rows").alias(rows)] if rows else []
    return totals.select(
        F.col("_key").alias(key), *counted, *shown[2:], *[r.alias(c) for r, c in zip(results, columns)]
    )


def distinct_values(df: DataFrame, key: str, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Distinct values: ``(key, column, value, first)``, one row per value, blank ones
    included, so that every key has a row.

    ``column`` is the position in ``columns``. Grouping includes the value, so a large
    key spreads over all tasks, and repeated values fold before the shuffle.
    """
    rows = df.select(
        normalise_text(F.col(quoted(key))).alias("_key"),
        order_key(order_by).alias("_first"),
        *[normalise_text(F.col(quoted(c))).alias(str(i)) for i, c in enumerate(columns)],
    )
    return (
        rows.unpivot(["_key", "_first"], [str(i) for i in range(len(columns))], "_column", "_value")
        .groupBy("_key", "_column", "_value")
        .agg(F.min("_first").alias("_first"))
    )


def _cell(sep: str) -> Column:
    """The non-blank values of a group in first-seen order, ties by value."""
    entry = F.when(F.col("_value") != "", F.struct("_first", "_value"))
    return F.array_join(F.sort_array(F.collect_list(entry))["_value"], sep)


def unique_join(
    df: DataFrame, key: str, column: str, order_by: Sequence[str], sep: str | None = None
) -> DataFrame:
    """Distinct non-blank values of one column per key, joined in first-seen order."""
    cells = distinct_values(df, key, [column], order_by).groupBy("_key").agg(_cell(join_separator(sep)).alias("_cell"))
    return cells.select(F.col("_key").alias(key), F.col("_cell").alias(column))


def group_aggregate(
    df: DataFrame,
    key: str,
    sum_cols: Sequence[str],
    order_by: Sequence[str],
    sep: str | None = None,
    columns: Sequence[str] | None = None,
    strict: bool = False,
    first: str | None = None,
) -> DataFrame:
    """One row per key: count, key, then ``columns`` in their order.

    Columns in ``sum_cols`` are summed exactly and rounded to two places; the others
    join their distinct non-blank values in the order given by ``order_by``, ties by
    value. ``columns`` defaults to all but the key and the order columns. ``first``
    names an added column with the order of the key's first row, by which
    ``sinks.write_grouped`` writes groups in first-seen order.

    Every cell is whole. Each is joined in a task of its own, and a row that Spark
    cannot hold (2 GB) fails the job; :func:`long_cells` gives the same cells in bounded
    parts.

    ``strict`` first checks the sum columns in a job of its own and raises if any
    holds a value that is not an amount; otherwise such values count as nothing.
    """
    if key not in df.columns:
        raise ValueError(f"key column not found: {key}")
    if columns is None:
        columns = [c for c in df.columns if c != key and c not in order_by]
    sum_cols = [c for c in sum_cols if c != key]
    if strict and sum_cols:
        check_amounts(df, sum_cols)
    sep = join_separator(sep)
    texts = [c for c in columns if c not in sum_cols]

    sums = {c: f"s{i}" for i, c in enumerate(columns) if c in sum_cols}
    raw = df.select(
        F.col(quoted(key)).alias("_key"),
        *([order_key(order_by).alias("_order")] if first else []),
        *[F.col(quoted(c)).alias(s) for c, s in sums.items()],
    )
    result = exact_sum(raw, "_key", list(sums.values()), rows="_rows", first=F.col("_order") if first else None)
    if texts:
        cells = distinct_values(df, key, texts, order_by).groupBy("_key", "_column").agg(_cell(sep).alias("_cell"))
        wide = [F.max(F.when(F.col("_column") == str(i), F.col("_cell"))).alias(f"c{i}") for i in range(len(texts))]
        result = result.join(cells.groupBy("_key").agg(*wide), "_key")
    outputs = [
        round_text_half_up(F.col(sums[c])).alias(c) if c in sums else F.col(f"c{texts.index(c)}").alias(c) for c in columns
    ]
    firsts = [F.col("_first").alias(first)] if first else []
    return result.select(F.col("_rows").alias(ROWS_COLUMN), F.col("_key").alias(key), *outputs, *firsts)


def long_cells(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: Sequence[str],
    sep: str | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All non-empty joined texts in parts: ``(key, column, part, text)``.

    Joining the parts of a cell with the separator gives its whole text. A part holds
    about ``part_bytes`` and at least one value, so no task holds a whole cell. Part
    numbers rise, and skip where one value is larger than a part.
    """
    sep = join_separator(sep)
    values = distinct_values(df, key, columns, order_by).filter(F.col("_value") != "")
    values = values.withColumn("_bytes", F.octet_length("_value").cast("long") + len(sep.encode()))
    placed = with_position(
        values, ["_key", "_column"], ["_first", "_value"], weight="_bytes", weight_before="_before"
    )
    part = F.floor(F.col("_before") / part_bytes) + 1
    names = F.array(*[F.lit(c) for c in columns])
    parts = placed.groupBy("_key", "_column", part.alias("_part")).agg(_cell(sep).alias("text"))
    return parts.select(
        F.col("_key").alias(key),
        F.get(names, F.col("_column").cast("int")).alias("column"),
        F.col("_part").alias("part"),
        "text",
    )


def run_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a run."""
    counts = before.agg(F.count("*").alias("rows_before"), F.lit(0).cast("long").alias("rows_after")).unionByName(
        after.agg(F.lit(0).cast("long").alias("rows_before"), F.count("*").alias("rows_after"))
    )
    return counts.agg(F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"))
