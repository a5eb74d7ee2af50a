"""Tables read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import null_missing, plain_text, quoted


def as_text(df: DataFrame, blank_missing: bool = True) -> DataFrame:
    """Every column as text under its stripped name.

    A projection over any Spark source, so column pruning still reaches the scan. As
    a sheet reader does, missing tokens become null; ``blank_missing=False`` keeps them.
    Names that are equal once stripped are refused.
    """
    names = [field.name.strip() for field in df.schema.fields]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns of the same stripped name: {twice}")
    columns = []
    for field in df.schema.fields:
        text = plain_text(F.col(quoted(field.name)), field.dataType)
        columns.append((null_missing(text) if blank_missing else text).alias(field.name.strip()))
    return df.select(*columns)
