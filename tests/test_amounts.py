"""Expression tables: one literal row per rule."""

import decimal
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tabkit.functions import amounts, text
from tabkit.functions.files import file_link, folder_of, name_of, size_mb, suffix_of
from tabkit.lookups import AMOUNT_MISSING, TEXT_MISSING, compatibility_folds

INVALID = "invalid"
CASES = [
    ("(1,234.50)", "-1234.50", "-1234.50"),
    ("（１２３）", "-123", "-123"),
    ("(+5)", "-5", "-5"),
    ("(-5)", "-5", "-5"),
    ("(+-5)", "--5", INVALID),
    ("- 5", "-5", "-5"),
    ("+5", "+5", "5"),
    ("1,2,3", "123", "123"),
    (".38", ".38", "0.38"),
    ("-.38", "-.38", "-0.38"),
    ("$-", None, None),
    ("(-)", None, None),
    ("()", None, None),
    ("(", "(", INVALID),
    ("—", None, None),
    ("NaN", None, None),
    (" n/a ", None, None),
    ("", None, None),
    (None, None, None),
    ("　￥1，234．5 元", "1234.5元", INVALID),
    ("¥ 1 000", "1000", "1000"),
    ("$(5)", "(5)", INVALID),
    ("( $5 )", "-5", "-5"),
    ("5​6﻿7", "567", "567"),
    ("−7", "-7", "-7"),
    ("⁻7", "-7", "-7"),
    ("⑴", "-1", "-1"),
    ("⒈5", "1.5", "1.5"),
    ("㉛", "31", "31"),
    ("…5", "...5", INVALID),
    ("5.", "5.", INVALID),
    ("1e5", "1e5", INVALID),
    ("12%", "12%", INVALID),
    ("½", "½", INVALID),
    ("٣.٥", "٣.٥", "3.5"),
    ("1\n2", "12", "12"),
    ("1\x1c2", "12", "12"),
    ("12345678901234567890123456.5", "12345678901234567890123456.5", "12345678901234567890123456.5"),
    ("0.00000000005", "0.00000000005", "0.0000000001"),
]


def test_clean_and_parse_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw string")
    single = df.withColumns({"one": amounts.clean_amount(F.col("raw")), "value1": amounts.parse_amount(F.col("raw"))})
    staged = amounts.with_amounts(amounts.with_tokens(single, {"token": "raw"}), {"value": "raw"})
    bad = staged.withColumn("bad", amounts.is_bad_amount(F.col("token")))
    for row in bad.collect():
        raw, token, value = CASES[row["id"]]
        assert row["token"] == token, raw
        assert row["one"] == token, raw
        want = None if value in (None, INVALID) else decimal.Decimal(value)
        assert row["value"] == want, raw
        assert row["value1"] == want, raw
        assert row["bad"] == (value == INVALID), raw


def test_too_wide_amounts_are_numbers_that_a_decimal_refuses(spark):
    df = spark.createDataFrame([("1" * 29,)], "`a.b` string")
    tokens = amounts.with_tokens(df, {"token": "a.b"})
    assert not tokens.select(amounts.is_bad_amount(F.col("token"))).first()[0]
    for value in (amounts.parse_amount(F.col("`a.b`")), amounts.amount_of(F.col("`a.b`"), "a.b")):
        with pytest.raises(Exception, match="more than 28 digits"):
            df.select(value).collect()
    with pytest.raises(Exception, match="a.b"):
        amounts.with_amounts(df, {"v": "a.b"}).collect()


def test_fold_agrees_with_unicode(spark):
    """Every folding character, alone and inside text, gives its NFKC form."""
    chars = list(compatibility_folds())
    rows = [(c, f"1{c}2", "x" + c + random.choice(chars)) for c in chars]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for row in df.select(*[F.struct(c, amounts.fold_fullwidth(F.col(c)).alias("f")).alias(c) for c in "abc"]).collect():
        for cell in row:
            assert cell["f"] == unicodedata.normalize("NFKC", cell[0])


def test_missing_tokens(spark):
    df = spark.createDataFrame([(t,) for t in AMOUNT_MISSING], "raw string")
    assert df.filter(amounts.clean_amount(F.col("raw")).isNotNull()).count() == 0
    df = spark.createDataFrame([(t,) for t in [*TEXT_MISSING, None, " NA", "nA"]], "raw string")
    kept = [r[0] for r in df.select(text.blank_missing(F.col("raw"))).collect() if r[0]]
    assert sorted(kept) == [" NA", "nA"]


@pytest.mark.parametrize("value, want", [("2.345", 2.35), ("-2.345", -2.35), ("2.3449999999", 2.34), (None, 0.0)])
def test_round_half_up(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(amounts.round_half_up(F.col("v").cast("decimal(38,10)"))).first()[0] == want


def test_strip_is_pythons_strip(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿", "\x00", "\x1b"]
    rows = [f"{a}x{a} y{a}" for a in spaces]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select("v", text.normalise_text(F.col("v")).alias("s"), text.strip_all_space(F.col("v")).alias("q"))
    for row in got.collect():
        assert row["s"] == row["v"].strip()
        assert row["q"] == "".join(row["v"].split()).replace("​", "").replace("﻿", "")


@pytest.mark.parametrize(
    "raw, want",
    [(None, "；"), ("", "；"), ("  ", "；"), (" | ", "|"), ('" | "', " | "), ("','", ","), ('""', "；"), ("、", "、")],
)
def test_join_separator(raw, want):
    assert text.join_separator(raw) == want


def test_plain_text_of_doubles(spark):
    values = [1.0, 0.0, -0.5, 12345678.9, 1e7, 1e-7, 1e22, 68423.46, 0.1, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text.plain_text(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == ["1", "0", "-0.5", "12345678.9", "10000000", "0.0000001", "1.0E22", "68423.46", "0.1", None]


def test_path_parts(spark):
    from pathlib import PurePosixPath

    paths = ["/a/b.txt", "/a b/c.tar.gz", "/a/.hidden", "/a/.x.y", "/a/noext", "/a/end.", "/a/b.c/d", "/r.TXT", "/a/我.数"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    name = name_of(F.col("path"))
    got = df.select("path", folder_of(F.col("path")).alias("folder"), name.alias("name"), suffix_of(name).alias("ext"))
    for row in got.collect():
        path = PurePosixPath(row["path"])
        assert (row["name"], row["ext"]) == (path.name, path.suffix)
        assert row["folder"] == str(path.parent)


def test_size_and_link(spark):
    lengths = [0, 131072, 393216, 1048576, 5, 12345678]
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    assert [r[0] for r in df.select(size_mb(F.col("n"))).collect()] == [round(n / 1048576, 2) for n in lengths]
    df = spark.createDataFrame([("/a b/c+d%.txt",)], "p string")
    assert df.select(file_link(F.col("p"))).first()[0] == "file:////a%20b/c+d%.txt"
