"""Group aggregate, positions and validation against plain Python."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from tabkit.operators import group, ranking, validate
from tabkit.lookups import ROWS_COLUMN

rng = random.Random(5)


def brute_force(rows, sep):
    """rows: (ord, key, amount, text). One dict entry per key in first-seen order."""
    out = {}
    for _, key, amount, value in sorted(rows, key=lambda r: (r[0], (r[3] or "").strip())):
        key = (key or "").strip()
        entry = out.setdefault(key, [0, decimal.Decimal(0), []])
        entry[0] += 1
        try:
            entry[1] += decimal.Decimal((amount or "").replace(",", ""))
        except decimal.InvalidOperation:
            pass
        value = (value or "").strip()
        if value and value not in entry[2]:
            entry[2].append(value)
    half = decimal.ROUND_HALF_UP
    return {
        k: (n, float(total.quantize(decimal.Decimal("0.01"), half)), sep.join(values))
        for k, (n, total, values) in out.items()
    }


@pytest.fixture(scope="module")
def rows():
    keys = ["hot"] * 6 + [" hot", "a", "b\t", "", None, "c"]
    return [
        (
            i // 2,
            rng.choice(keys),
            rng.choice(["1,000.005", "2.5", "-3", "x", "", None, "0.01"]),
            rng.choice(["v", " v", "w ", "", None, "u", f"n{rng.randrange(40)}"]),
        )
        for i in range(3000)
    ]


SCHEMA = "ord int, `key col` string, `amt.x` string, txt string"


@pytest.mark.parametrize("partitions", [1, 7])
def test_group_aggregate_equals_brute_force(spark, rows, partitions):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = group.group_aggregate(df, "key col", ["amt.x"], ["ord"], sep="|")
    assert got.columns == [ROWS_COLUMN, "key col", "amt.x", "txt"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double", "string"]
    assert {r[1]: (r[0], r[2], r[3]) for r in got.collect()} == brute_force(rows, "|")


def test_parts_join_to_the_whole_cell_of_every_key(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = {k: v[2] for k, v in brute_force(rows, "|").items() if v[2]}
    parts = group.long_cells(df, "key col", ["txt"], ["ord"], sep="|", part_bytes=30)
    joined = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        assert r["column"] == "txt" and len(r["text"]) < 40
        joined.setdefault(r["key col"], []).append(r["text"])
    assert {k: "|".join(v) for k, v in joined.items()} == want
    assert max(map(len, joined.values())) > 3


def test_unique_join_keeps_keys_without_values(spark):
    df = spark.createDataFrame([("a", 1, " "), ("a", 2, None), ("b", 3, "x"), (None, 4, "y")], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in group.unique_join(df, "k", "v", ["o"]).collect()} == {"a": "", "b": "x", "": "y"}


def test_wide_amounts_are_summed_or_refused(spark):
    rows = [("a", "9" * 27), ("a", "2"), ("b", "0.00000000004"), ("b", "0.00000000004"), ("b", "-0.000000000000001")]
    df = spark.createDataFrame(rows, "k string, `a.b` string")
    sums = group.decimal_sum(df, "k", ["a.b"])
    assert sums.schema["a.b"].dataType.simpleString() == "decimal(38,10)"
    got = {r["k"]: r["a.b"] for r in sums.collect()}
    assert got == {"a": decimal.Decimal("1" + "0" * 26 + "1"), "b": decimal.Decimal("1E-10")}
    with pytest.raises(Exception, match="a.b.*more than 28 digits"):
        group.decimal_sum(spark.createDataFrame([("a", "1" * 29)], "k string, `a.b` string"), "k", ["a.b"]).collect()


def test_sums_of_any_width(spark):
    """Against decimals of unlimited digits, with carries and signs across all limbs."""
    rng = random.Random(4)

    def number():
        whole, fraction = rng.choice([0, 1, 15, 16, 18, 36, 37, 90]), rng.choice([0, 1, 10, 11, 18, 35, 60])
        digits = "".join(rng.choice("0099123") for _ in range(whole)) or ("" if fraction else "0")
        return rng.choice(["", "-", "+"]) + digits + ("." + "".join(rng.choice("0959") for _ in range(fraction)) if fraction else "")

    rows = [(f"k{i % 40}", number(), number()) for i in range(400)]
    wide = "9" * 40
    rows += [("zero", wide, "-0.0"), ("zero", "-" + wide, "x"), ("carry", wide, "0." + "9" * 35), ("carry", "1", "0." + "0" * 34 + "1")]
    rows += [("minus", "(" + wide + ")", "1"), ("minus", "1", "(1.5)"), ("none", None, "n/a"), (None, "x", wide + "." + wide)]
    df = spark.createDataFrame(rows, "`k.k` string, `a.b` string, _row string").repartition(5)
    got = {r["k.k"]: (r["n"], r["a.b"], r["_row"]) for r in group.exact_sum(df, "k.k", ["a.b", "_row"], rows="n").collect()}

    def plain(values):
        with decimal.localcontext(prec=500):
            valid = [decimal.Decimal(v.replace("(", "-").replace(")", "")) for v in values if v and v not in ("x", "n/a")]
            total = sum(valid, decimal.Decimal(0))
            return format(total.normalize(), "f") if total else "0"

    keys = {k or "" for k, _, _ in rows}
    want = {k: [r for r in rows if (r[0] or "") == k] for k in keys}
    assert got == {k: (len(v), plain([r[1] for r in v]), plain([r[2] for r in v])) for k, v in want.items()}
    result = group.group_aggregate(df.withColumn("o", F.lit(1)), "k.k", ["a.b"], ["o"])
    assert {r["k.k"]: r["a.b"] for r in result.collect()}["carry"] == 1e40
    assert group.exact_sum(df.limit(0), "k.k", ["a.b"]).count() == 0


def test_first_seen_order_of_groups_is_written(spark, tmp_path):
    from tabkit import sinks

    rows = [(" k", 5, "1"), ("z", 2, "2"), ("k", 3, "3"), ("b.x", 9, "4")]
    df = spark.createDataFrame(rows, "`key.x` string, `o.x` int, amt string")
    result = group.group_aggregate(df, "key.x", ["amt"], ["o.x"], first="seen")
    sinks.write_grouped(result, ["amt"], str(tmp_path / "g"), first="seen")
    names = sorted(str(f) for f in (tmp_path / "g").glob("*.parquet"))
    written = [r["key.x"] for f in names for r in spark.read.parquet(f).collect()]
    order = ranking.first_seen_order(df, "key.x", ["o.x"]).orderBy("position").collect()
    assert written == [r["key.x"] for r in order] == ["z", "k", "b.x"]
    assert "seen" not in spark.read.parquet(names[0]).columns


def test_first_rows_of_any_number(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g.x"), F.col("id").alias("i.x"))
    got = ranking.first_n_per_group(df, ["g.x"], ["i.x"], 1500)
    assert got.columns == ["g.x", "i.x", "row_in_group"]
    assert sorted(tuple(r) for r in got.collect()) == [(g, 2 * i + g, i + 1) for g in (0, 1) for i in range(1500)]
    assert ranking.first_n_per_group(df, ["g.x"], ["i.x"], 0).count() == 5000


def test_composite_order(spark):
    df = spark.createDataFrame([("k", 2, 1, "b"), ("k", 1, 9, "a"), ("k", 1, 3, "c")], "k string, x int, y int, v string")
    assert group.unique_join(df, "k", "v", ["x", "y"], sep=",").first()["v"] == "c,a,b"


def test_empty_table_keeps_schema(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = group.group_aggregate(df, "key col", ["amt.x"], ["ord"])
    assert got.count() == 0 and got.columns == [ROWS_COLUMN, "key col", "amt.x", "txt"]


def test_missing_key_and_strict(spark):
    df = spark.createDataFrame([(1, "a", "5", "t"), (2, "a", "5%", "t")], SCHEMA)
    with pytest.raises(ValueError, match="nope"):
        group.group_aggregate(df, "nope", [], ["ord"])
    with pytest.raises(ValueError, match="amt.x"):
        group.group_aggregate(df, "key col", ["amt.x"], ["ord"], strict=True)
    assert group.group_aggregate(df, "key col", ["amt.x"], ["ord"]).first()["amt.x"] == 5.0


def test_totals_beyond_the_type_are_exact_or_fail_loudly(spark):
    df = spark.createDataFrame([(i, "a", "9" * 28, "t") for i in range(20)], SCHEMA)
    total = 20 * int("9" * 28)
    assert group.exact_sum(df, "key col", ["amt.x"]).first()["amt.x"] == str(total)
    assert group.group_aggregate(df, "key col", ["amt.x"], ["ord"]).first()["amt.x"] == float(total)
    with pytest.raises(Exception, match="amt.x.*more than 28 digits"):
        group.decimal_sum(df, "key col", ["amt.x"]).collect()


def test_validate_and_samples(spark):
    rows = [(i, "x%" if i % 3 == 0 else "5", "1" if i else None) for i in range(30)]
    df = spark.createDataFrame(rows, "ord int, a string, b string")
    checks = {r["column"]: (r["bad_values"], r["ok"]) for r in validate.validate_columns(df, ["a", "b"]).collect()}
    assert checks == {"a": (10, False), "b": (0, True)}
    samples = validate.invalid_samples(df, ["a", "b"], ["ord"]).collect()
    assert sorted((r["column"], r["sample"], r["raw"], r["token"]) for r in samples) == [
        ("a", i, "x%", "x%") for i in range(1, 6)
    ]


def test_positions_equal_row_number(spark):
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randrange(9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, i int, w long").repartition(5)
    got = ranking.with_position(df, ["g"], ["i"], weight="w").collect()
    groups = {}
    for g, i, w in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((i, w))
    assert len(got) == len(rows)
    for r in got:
        members = groups[r["g"]]
        assert members[r["position"] - 1][0] == r["i"]
        assert r["group_size"] == len(members)
        assert r["weight_before"] == sum(w for _, w in members[: r["position"] - 1])


def test_positions_over_all_rows(spark):
    df = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("v"))
    got = ranking.with_position(df, [], ["v"]).orderBy("v").collect()
    assert [r["position"] for r in got] == list(range(1, 10_001))
    assert {r["group_size"] for r in got} == {10_000}


def test_first_seen_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 1)], "k string, o int")
    got = ranking.first_seen_order(df, "k", ["o"]).collect()
    assert sorted((r["position"], r["k"]) for r in got) == [(1, "b"), (2, "c"), (3, "a")]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = ranking.first_n_per_group(df, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_preview(spark):
    df = spark.range(50)
    assert [r[0] for r in ranking.preview(df, ["id"], 3).collect()] == [0, 1, 2]
    assert ranking.preview(df, ["id"], 0).count() == 50


def test_generated_code_of_sums_is_small_enough_to_compile(spark):
    """The JVM leaves methods of over 8000 bytes to its interpreter."""
    import re

    df = spark.createDataFrame([("a", "1", "$2", "（3）")], "k string, x string, y string, z string")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = group.exact_sum(df, "k", ["x", "y", "z"])._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(size) for size in re.findall("maxMethodCodeSize:([0-9]+)", text)]
    assert sizes and max(sizes) < 8000


def test_sums_of_limbs_inside_and_outside_of_their_columns(spark):
    from fractions import Fraction

    amounts = ["9" * 54 + "." + "9" * 36, "-" + "9" * 54, "7" * 55, "(0." + "3" * 37 + ")", "1" * 19, "-0.00000000001", "5.5"]
    rows = [(f"k{i % 3}", a) for i, a in enumerate(amounts * 4)]
    df = spark.createDataFrame(rows, "k string, x string").repartition(3)
    want = {}
    for k, a in rows:
        value = Fraction(a.strip("()")) * (-1 if a[0] == "(" else 1)
        want[k] = want.get(k, 0) + value
    assert {r["k"]: Fraction(r["x"]) for r in group.exact_sum(df, "k", ["x"]).collect()} == want
