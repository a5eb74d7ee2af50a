"""Accounting-style amounts as Column expressions.

Everything here stays in the JVM. One ``translate`` drops currency marks, thousands
separators and inner white space and maps the Unicode minus in a single scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import is_non_ascii, quoted, strip
from tabkit.lookups import (
    AMOUNT_MISSING,
    CURRENCY,
    THOUSANDS,
    UNICODE_MINUS,
    WHITESPACE,
    ZERO_WIDTH,
    compatibility_folds,
    decimal_digits,
)

# 28 integer digits and 10 decimals; Spark's sum of it keeps the same type.
AMOUNT_TYPE = "decimal(38,10)"
# Amounts that are summed as they are: 15 digits and 10 decimals, so that the sum of 10^13
# of them fits. Wider ones are cut into limbs of 18 digits, summed place by place.
PART_TYPE = "decimal(28,10)"
LIMB, LIMB_TYPE = 18, "decimal(38,0)"
# The places of limbs, 0 being the last before the point, that have columns of their own
# where all of an amount is among them. Limbs are summed as two halves of nine digits, of
# which a task can add nine thousand million in a long.
PLACES = range(-2, 3)
HALF = 10 ** (LIMB // 2)
LIMB_ENTRIES = f"array<struct<_column: int, _at: int, _limb: {LIMB_TYPE}>>"
_NARROW = r"^[+-]?([0-9]{1,15}(\.[0-9]{1,10})?|\.[0-9]{1,10})\z"

_NUMBER = r"^[+-]?(\p{Nd}+(\.\p{Nd}+)?|\.\p{Nd}+)\z"


def fold_fullwidth(text: Column) -> Column:
    """Compatibility fold of every character an amount or a missing token can use."""
    folds = compatibility_folds()
    single = {c: f for c, f in folds.items() if len(f) == 1}
    several = {c: f for c, f in folds.items() if len(f) > 1}
    folded = F.translate(text, "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(part) for pair in several.items() for part in pair])
    expanded = F.array_join(
        F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    # A translate finds characters far faster than a pattern with as many alternatives.
    # The array function ends the generated stage here, which pays: with a chain of
    # replacements instead, stages grow past what the JVM compiles, at twice the time.
    return (
        F.when(~is_non_ascii(text), text)
        .when(F.translate(text, "".join(several), "") != text, expanded)
        .otherwise(folded)
    )


def is_bracketed(text: Column) -> Column:
    return text.startswith("(") & text.endswith(")") & (F.char_length(text) >= 2)


def drop_marks(text: Column) -> Column:
    """Remove currency marks, thousands separators and all white space; '−' → '-'."""
    dropped = CURRENCY + THOUSANDS + WHITESPACE + ZERO_WIDTH
    # A pattern tells plain numbers several times faster than a translate copies them.
    return F.when(text.rlike(r"^[+-]?[0-9.]*\z"), text).otherwise(F.translate(text, UNICODE_MINUS + dropped, "-"))


def inner_text(bare: Column, bracketed: Column) -> Column:
    """Text without its brackets; dropping marks leaves them first and last."""
    return F.when(bracketed, F.substring(bare, F.lit(2), F.char_length(bare) - 2)).otherwise(bare)


def signed_token(bare: Column, bracketed: Column) -> Column:
    """Token with the sign of its brackets, or null when the amount is missing."""
    unsigned = F.when(bare.startswith("+"), F.substring(bare, F.lit(2), F.char_length(bare))).otherwise(bare)
    token = F.when(bracketed & ~bare.startswith("-"), F.concat(F.lit("-"), unsigned)).otherwise(bare)
    return F.when(~bare.isin(*AMOUNT_MISSING), token)


def clean_amount(raw: Column) -> Column:
    """Cleaned token of an amount as one expression; null when the amount is missing.

    For whole columns use :func:`with_tokens`, which evaluates each step once.
    """
    text = strip(fold_fullwidth(raw.cast("string")))
    bracketed = is_bracketed(text)
    return signed_token(inner_text(drop_marks(text), bracketed), bracketed)


def with_tokens(df: DataFrame, tokens: Mapping[str, str]) -> DataFrame:
    """Add the cleaned token of each raw column: ``{new column: raw column}``.

    One projection per step: as a single expression the steps repeat inside each
    other, and Spark evaluates the repeats again, at two to four times the cost.
    """
    text, bare, bracketed = "{} text".format, "{} bare".format, "{} bracketed".format
    keep = [F.col(quoted(c)) for c in df.columns]
    folded = {t: strip(fold_fullwidth(F.col(quoted(raw)).cast("string"))) for t, raw in tokens.items()}
    df = df.select(*keep, *[c.alias(text(t)) for t, c in folded.items()])
    df = df.select(
        *keep,
        *[is_bracketed(F.col(quoted(text(t)))).alias(bracketed(t)) for t in tokens],
        *[drop_marks(F.col(quoted(text(t)))).alias(bare(t)) for t in tokens],
    )
    inner = {t: inner_text(F.col(quoted(bare(t))), F.col(quoted(bracketed(t)))) for t in tokens}
    df = df.select(*keep, *[F.col(quoted(bracketed(t))) for t in tokens], *[c.alias(bare(t)) for t, c in inner.items()])
    return df.select(
        *keep, *[signed_token(F.col(quoted(bare(t))), F.col(quoted(bracketed(t)))).alias(t) for t in tokens]
    )


def with_amounts(df: DataFrame, amounts: Mapping[str, str]) -> DataFrame:
    """Add the decimal value of each raw column, rounded half-up: ``{new column: raw column}``."""
    keep = [F.col(quoted(c)) for c in df.columns]
    df = with_tokens(df, {f"{a} token": raw for a, raw in amounts.items()})
    tokens = {a: ascii_digits(F.col(quoted(f"{a} token"))) for a in amounts}
    return df.select(*keep, *[_value(t, amounts[a]).alias(a) for a, t in tokens.items()])


def with_parts(df: DataFrame, amounts: Mapping[str, str]) -> DataFrame:
    """Add what exact sums are made of, per raw column: ``{new column: raw column}``.

    ``<new>`` holds amounts of up to 15 digits before the point and 10 behind it as
    decimals. Of any wider one ``<new> digits`` holds all digits, filled up on both sides
    to limbs of 18, ``<new> high`` the number of limbs before the point and
    ``<new> sign`` a minus or nothing.
    """
    keep = [F.col(quoted(c)) for c in df.columns]
    df = with_tokens(df, {a: raw for a, raw in amounts.items()})
    df = df.select(*keep, *[ascii_digits(F.col(quoted(a))).alias(a) for a in amounts])
    own = [F.col(quoted(a)) for a in amounts]
    df = df.select(*keep, *own, *[F.col(quoted(a)).rlike(_NARROW).alias(f"{a} narrow") for a in amounts])
    parts = []
    for a in amounts:
        token, narrow = F.col(quoted(a)), F.col(quoted(f"{a} narrow"))
        plain = F.when(~narrow & is_amount(token), F.ltrim(token, F.lit("+-")))
        minus = F.when(token.startswith("-"), "-").otherwise("")
        parts += [F.when(narrow, token.try_cast(PART_TYPE)).alias(a), plain.alias(f"{a} plain"), minus.alias(f"{a} sign")]
    df = df.select(*keep, *parts)
    limbs = []
    for a in amounts:
        digits, high = limb_digits(F.col(quoted(f"{a} plain")))
        limbs += [F.col(quoted(f"{a} sign")), digits.alias(f"{a} digits"), high.alias(f"{a} high")]
    return df.select(*keep, *own, *limbs)


def limb_digits(plain: Column) -> tuple[Column, Column]:
    """The digits of an unsigned number filled up to limbs, and how many are before the point."""

    def filled(text: Column) -> tuple[Column, Column]:
        limbs = F.ceil(F.char_length(text) / LIMB).cast("int")
        return limbs, limbs * LIMB

    whole = F.substring_index(plain, ".", 1)
    fraction = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
    high, places = filled(whole)
    return F.concat(F.lpad(whole, places, F.lit("0")), F.rpad(fraction, filled(fraction)[1], F.lit("0"))), high


def limb_at(digits: Column, sign: Column, number: Column) -> Column:
    """The limb of a number, from 0 at the left."""
    return F.concat(sign, F.substring(digits, number * LIMB + 1, F.lit(LIMB))).cast(LIMB_TYPE)


def in_places(digits: Column, high: Column) -> Column:
    """Whether all limbs of an amount lie in ``PLACES``."""
    low = (F.octet_length(digits) / LIMB).cast("int") - high
    return (high <= PLACES.stop) & (low <= -PLACES.start)


def long_limb(digits: Column, high: Column, sign: Column, place: int) -> Column:
    """The limb of a place as a long; null where the amount has none."""
    number = high - 1 - place
    there = (number >= 0) & (number * LIMB < F.octet_length(digits))
    limb = F.when(there, F.substring(digits, number * LIMB + 1, F.lit(LIMB)).cast("long"))
    return F.when(sign == "-", -limb).otherwise(limb)


def _entry(column: Column, at: Column, limb: Column) -> Column:
    return F.struct(
        column.cast("int").alias("_column"), at.cast("int").alias("_at"), limb.cast(LIMB_TYPE).alias("_limb")
    )


def all_limbs(digits: Column, high: Column, sign: Column, column: int) -> Column:
    """``LIMB_ENTRIES`` of all limbs of an amount, with the number of its column."""
    numbers = F.sequence(F.lit(0), (F.octet_length(digits) / LIMB).cast("int") - 1)
    return F.transform(numbers, lambda n: _entry(F.lit(column), high - 1 - n, limb_at(digits, sign, n)))


def no_limb() -> Column:
    return _entry(F.lit(None), F.lit(None), F.lit(None))


def half_sums(limb: Column) -> tuple[Column, Column]:
    """The sums of the upper and the lower half of long limbs."""
    return F.sum(F.call_function("div", limb, F.lit(HALF))), F.sum(limb % HALF)


def limbs_of_decimal(total: Column) -> Column:
    """``(at, limb)`` of a decimal: it is the sum of ``limb * 10**(18 * at)``."""
    digits, high = limb_digits(F.abs(total).cast("string"))
    sign = F.when(total < 0, "-").otherwise("")
    numbers = F.sequence(F.lit(0), (F.char_length(digits) / LIMB).cast("int") - 1)
    return F.transform(numbers, lambda n: F.struct((high - 1 - n).alias("at"), limb_at(digits, sign, n).alias("limb")))


def settled(limbs: Column, sign: int) -> Column:
    """The sum of limbs, which may share places and differ in sign, with all carries
    made: ``(carry, high, low)``, the last two as digits before and behind the point.
    A negative sum leaves a negative carry; settle it with ``sign`` -1 instead."""
    places = F.transform(limbs, lambda e: e["at"])
    none, base = F.lit(0).cast(LIMB_TYPE), F.lit(10**LIMB).cast("decimal(20,0)")

    def at(place: Column) -> Column:
        here = F.filter(limbs, lambda e: e["at"] == place)
        return F.aggregate(here, none, lambda s, e: (s + e["limb"] * sign).cast(LIMB_TYPE))

    def step(state: Column, place: Column) -> Column:
        value = (state["carry"] + at(place)).cast(LIMB_TYPE)
        digit = F.pmod(value, base).cast(LIMB_TYPE)
        carry = F.floor((value - digit).cast(LIMB_TYPE) / base).cast(LIMB_TYPE)
        digits = F.lpad(digit.cast("string"), LIMB, "0")
        low = F.when(place < 0, F.concat(digits, state["low"])).otherwise(state["low"])
        high = F.when(place < 0, state["high"]).otherwise(F.concat(digits, state["high"]))
        return F.struct(carry.alias("carry"), high.alias("high"), low.alias("low"))

    start = F.struct(none.alias("carry"), F.lit("").alias("high"), F.lit("").alias("low"))
    return F.aggregate(F.sequence(F.array_min(places), F.array_max(places)), start, step)


def plain_number(up: Column, down: Column) -> Column:
    """Settled limbs as text without needless zeros, e.g. ``-12.5``."""
    negative = up["carry"] < 0

    def part(name: str) -> Column:
        return F.when(negative, down[name]).otherwise(up[name])

    whole = F.ltrim(F.concat(part("carry").cast("string"), part("high")), F.lit("0"))
    whole = F.when(whole == "", "0").otherwise(whole)
    return F.concat(F.when(negative, "-").otherwise(""), plain_digits(F.concat(whole, F.lit("."), part("low"))))


def plain_digits(text: Column) -> Column:
    """A number with a point, without the zeros that end it."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def is_amount(token: Column) -> Column:
    """Whether a cleaned token is a pure number: no exponent, no '5.', no '%'."""
    return token.rlike(_NUMBER)


def parse_amount(raw: Column) -> Column:
    """Decimal value of a raw amount; null when missing or not a number. A number too
    wide for the type, with more than 28 digits before the point, fails the job."""
    return amount_of(clean_amount(raw))


def ascii_digits(token: Column) -> Column:
    digits = decimal_digits()
    plain = F.translate(token, "".join(digits), "".join(digits.values()))
    return F.when(is_non_ascii(token), plain).otherwise(token)


def amount_of(token: Column, column: str = "") -> Column:
    """The value of a cleaned token; ``column`` is named when it is too wide."""
    return _value(ascii_digits(token), column)


def _value(token: Column, column: str) -> Column:
    value = token.try_cast(AMOUNT_TYPE)
    message = F.concat(F.lit(f"an amount of column {column!r} has more than 28 digits before the point: "), token)
    # The pattern gates the cast: on its own the cast would take '5.' and '1e3'.
    return F.when(is_amount(token), F.coalesce(value, F.raise_error(message).cast(AMOUNT_TYPE)))


def is_bad_amount(token: Column) -> Column:
    """A present token that cannot count in a sum, as it is not a number."""
    return token.isNotNull() & ~is_amount(token)


def round_half_up(amount: Column) -> Column:
    """Two places, ties away from zero, as a double; null becomes 0."""
    return F.coalesce(F.round(amount, 2).cast("double"), F.lit(0.0))


def round_text_half_up(total: Column) -> Column:
    """The same for plain text of any width; from 10^36 on a double has no places."""
    return F.coalesce(total.try_cast("decimal(38,2)").cast("double"), total.cast("double"), F.lit(0.0))
