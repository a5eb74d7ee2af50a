"""File records as Column expressions: path parts, sizes, types, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.lookups import CATEGORIES, OTHER_CATEGORY, SIGNATURES, TITLE_WIDTH, ZIP_PACKAGES


def folder_of(path: Column) -> Column:
    """Everything before the last slash; '/' for a file right below the root."""
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((folder == "") & path.startswith("/"), "/").otherwise(folder)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_of(name: Column) -> Column:
    """From the last dot; names whose only dots lead them, or that end in one, have none."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]+)$", 1)


def size_mb(length: Column) -> Column:
    """Megabytes with two places, ties to even."""
    return F.bround(length / F.lit(1048576), 2)


def time_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def file_link(path: Column) -> Column:
    """Only blanks are escaped."""
    return F.concat(F.lit("file:///"), F.replace(path, F.lit(" "), F.lit("%20")))


def part_title(category: Column, part: Column, parts: Column) -> Column:
    numbered = F.concat(category, F.lit("_part"), part.cast("string"))
    return F.substring(F.when(parts == 1, category).otherwise(numbered), 1, TITLE_WIDTH)


def relative_path(path: Column, root: str) -> Column:
    """Path below a qualified root; a path elsewhere fails the job."""
    base = root.rstrip("/") + "/"
    below = F.substring(path, F.lit(len(base) + 1), F.char_length(path))
    elsewhere = F.raise_error(F.concat(path, F.lit(f" is not below {base}"))).cast("string")
    return F.when(path.startswith(base), below).otherwise(elsewhere)


def relative_output_path(path: Column, root: str) -> Column:
    """Path below a qualified root without its extension."""
    below = relative_path(path, root)
    suffix = suffix_of(name_of(path))
    return F.substring(below, F.lit(1), F.char_length(below) - F.char_length(suffix))


def category_rules(spark: SparkSession) -> DataFrame:
    """Lookup ``(rule_ext, category)``; an extension keeps its first category."""
    first: dict[str, str] = {}
    for category, extensions in CATEGORIES.items():
        for ext in extensions:
            first.setdefault(ext, category)
    return spark.createDataFrame(list(first.items()), "rule_ext string, category string")


def categorise(df: DataFrame, ext: str = "ext") -> DataFrame:
    """Add ``category`` by extension. The lookup is fixed, about a hundred rows, so it
    is always broadcast."""
    rules = F.broadcast(category_rules(df.sparkSession))
    joined = df.join(rules, F.lower(F.col(ext)) == F.col("rule_ext"), "left").drop("rule_ext")
    return joined.withColumn("category", F.coalesce("category", F.lit(OTHER_CATEGORY)))


def _matches(head: Column, marks) -> Column:
    test = F.lit(True)
    for offset, magic in marks:
        test = test & (F.substring(head, offset + 1, len(magic)) == F.lit(bytearray(magic)))
    return test


def detected_type(head: Column) -> Column:
    """'mime (extension)' by the first signature that matches, else 'unknown'."""
    result = None
    zipped = _matches(head, ((0, b"PK\x03\x04"),))
    for mime, ext, folder in ZIP_PACKAGES:
        inside = F.contains(head, F.lit(bytearray(folder)))
        test, label = zipped & inside, F.lit(f"{mime} ({ext})")
        result = F.when(test, label) if result is None else result.when(test, label)
    for mime, ext, marks in SIGNATURES:
        result = result.when(_matches(head, marks), F.lit(f"{mime} ({ext})"))
    return result.otherwise(F.lit("unknown"))
