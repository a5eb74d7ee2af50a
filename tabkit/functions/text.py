"""Text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.lookups import JOIN_SEPARATOR, TEXT_MISSING, WHITESPACE, ZERO_WIDTH


def quoted(name: str) -> str:
    """A column name that may hold dots or blanks, for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def strip(text: Column) -> Column:
    """Cut Unicode white space from both ends; ``trim`` alone knows only U+0020."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalise_text(value: Column) -> Column:
    """Null-safe stripped text: null becomes ''."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def strip_all_space(text: Column) -> Column:
    """Remove white space and zero-width marks anywhere in the text."""
    return F.translate(text, WHITESPACE + ZERO_WIDTH, "")


def is_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.char_length(text)


def blank_missing(text: Column) -> Column:
    """Missing tokens of the delimited reader, and null, become ''."""
    return F.when(text.isNull() | text.isin(*TEXT_MISSING), F.lit("")).otherwise(text)


def null_missing(text: Column) -> Column:
    return F.when(~text.isin(*TEXT_MISSING), text)


def plain_text(value: Column, dtype: T.DataType) -> Column:
    """Any column as text. Floating columns are written out without exponent or
    trailing zeros, as a sheet shows them; beyond 20 integer or 18 fraction digits
    they keep Spark's own form, so that nothing is rounded away."""
    text = value.cast("string")
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return text
    exact = text.try_cast("decimal(38,18)")
    kept = exact.isNotNull() & (exact.cast(dtype) == value)
    trimmed = F.rtrim(F.rtrim(exact.cast("string"), F.lit("0")), F.lit("."))
    return F.when(kept, F.when(exact == 0, F.lit("0")).otherwise(trimmed)).otherwise(text)


def join_separator(raw: str | None) -> str:
    """Join separator option: strip, drop one pair of quotes, default '；'."""
    if raw is None:
        return JOIN_SEPARATOR
    text = str(raw).strip()
    for quote in "\"'":
        if text.startswith(quote) and text.endswith(quote):
            text = text[1:-1]
            break
    return text or JOIN_SEPARATOR
