"""Check that columns hold amounts before they are summed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.amounts import is_bad_amount, with_tokens
from tabkit.functions.text import quoted
from tabkit.operators.ranking import first_n_per_group, order_key

SAMPLES = 5


def validate_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, bad_values, ok)`` per column, from one pass over the table."""
    raw = df.select(*[F.col(quoted(c)).alias(str(i)) for i, c in enumerate(columns)])
    tokens = with_tokens(raw, {f"token {i}": str(i) for i in range(len(columns))})
    bad = [F.count_if(is_bad_amount(F.col(quoted(f"token {i}")))).alias(c) for i, c in enumerate(columns)]
    counts = tokens.agg(*bad).unpivot([], [quoted(c) for c in columns], "column", "bad_values")
    return counts.withColumn("ok", F.col("bad_values") == 0)


def invalid_samples(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = SAMPLES
) -> DataFrame:
    """Up to ``n`` first bad values per column: ``(column, sample, raw, token)``."""
    raw = df.select(
        order_key(order_by).alias("_order"),
        *[F.col(quoted(c)).cast("string").alias(f"raw {i}") for i, c in enumerate(columns)],
    )
    tokens = with_tokens(raw, {f"token {i}": f"raw {i}" for i in range(len(columns))})
    # Marked before they become rows: a filter on the token itself would be pushed
    # below the steps that make it, and repeat them all.
    marked = tokens.select(
        "_order",
        *[
            F.when(
                is_bad_amount(F.col(f"`token {i}`")),
                F.struct(F.col(f"`raw {i}`").alias("raw"), F.col(f"`token {i}`").alias("token")),
            ).alias(str(i))
            for i in range(len(columns))
        ],
    )
    bad = (
        marked.unpivot(["_order"], [str(i) for i in range(len(columns))], "_column", "_bad")
        .filter(F.col("_bad").isNotNull())
        .select("_order", "_column", "_bad.raw", "_bad.token")
    )
    first = first_n_per_group(bad, ["_column"], ["_order", "raw"], n)
    names = F.array(*[F.lit(c) for c in columns])
    return first.select(
        F.get(names, F.col("_column").cast("int")).alias("column"),
        F.col("row_in_group").alias("sample"),
        "raw",
        "token",
    )


def check_amounts(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise with the names of the columns that hold values which are not amounts."""
    failed = [r["column"] for r in validate_columns(df, columns).filter(~F.col("ok")).collect()]
    if failed:
        raise ValueError("not pure amounts: " + ", ".join(failed))
