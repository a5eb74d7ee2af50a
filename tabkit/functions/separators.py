"""Separator options and splitting lines into fields."""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabkit.functions.text import strip
from tabkit.lookups import DETECTION_ORDER, SUSPECT_MARKS, TAB_WORDS, WHITESPACE, WHITESPACE_WORDS


class Separator(NamedTuple):
    """``kind`` is 'auto', 'whitespace' or 'literal'."""

    kind: str
    text: str = ""

    @property
    def label(self) -> str:
        return self.text if self.kind == "literal" else self.kind


AUTO = Separator("auto")
ANY_WHITESPACE = Separator("whitespace")
CANDIDATES = tuple(
    ANY_WHITESPACE if mark == "whitespace" else Separator("literal", mark) for mark in DETECTION_ORDER
)


def separator_spec(raw: str) -> Separator:
    """Separator from a user's option; nothing is trimmed, blanks are meant exactly."""
    word = raw.lower()
    if raw == "":
        return AUTO
    if word in WHITESPACE_WORDS:
        return ANY_WHITESPACE
    if word in TAB_WORDS:
        return Separator("literal", "\t")
    return Separator("literal", raw)


def _trims_line(sep: Separator) -> bool:
    """Splitting on runs of white space or on several characters ignores the white
    space around the line; a single character does not."""
    return sep.kind == "whitespace" or len(sep.text) > 1


def split_fields(line: Column, sep: Separator) -> Column:
    """Fields of a line. Quotes are ordinary characters, separators are literal."""
    if _trims_line(sep):
        line = strip(line)
    if sep.kind == "whitespace":
        # A line holds no line break, so one can stand for each run of white space.
        return F.split(F.regexp_replace(line, f"[{WHITESPACE}]+", "\n"), "\n", -1)
    # A single escaped character keeps Java's split off the pattern compiler.
    pattern = "".join(f"\\{c}" if c in string.punctuation else c for c in sep.text)
    return F.split(line, pattern, -1)


def count_fields(line: Column, sep: Separator) -> Column:
    """Number of fields, without building them."""
    if sep.kind == "whitespace":
        return F.size(split_fields(line, sep))
    if _trims_line(sep):
        line = strip(line)
    dropped = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(sep.text), F.lit("")))
    return (dropped / len(sep.text.encode())).cast("int") + 1


def is_blank_line(line: Column, sep: Separator) -> Column:
    """Lines the reader skips: one field, of white space only.

    A line of nothing but separators is a row of empty fields, not a blank line. For
    a single visible separator only blanks and tabs count as white space.
    """
    if _trims_line(sep):
        return strip(line) == ""
    if sep.text.isspace():
        return (strip(line) == "") & ~line.contains(sep.text)
    return F.btrim(line, F.lit(" \t")) == ""


def by_label(label: Column, separators: Sequence[Separator], expression) -> Column:
    """``expression(separator)`` for the separator a row's label names."""
    if len(separators) == 1:
        return expression(separators[0])
    choice = F.when(label == separators[0].label, expression(separators[0]))
    for sep in separators[1:]:
        choice = choice.when(label == sep.label, expression(sep))
    return choice


def looks_unsplit(field: Column) -> Column:
    """Whether a field still holds a common separator."""
    return field.rlike(SUSPECT_MARKS)


def output_separators(sep: Separator) -> tuple[Separator, ...]:
    """The separators that can be in use under an option."""
    return CANDIDATES if sep.kind == "auto" else (sep,)
