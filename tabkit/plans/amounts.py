"""Queries over messy amounts and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit.functions import amounts, text
from tabkit.operators import group, ranking, validate
from tabkit.plans.inputs import FULLWIDTH, TOTAL, derived, derived_sql, table
from tabkit.plans.registry import query

@query(
    "clean_amount",
    f"SELECT ord, k, amt, CAST(want AS STRING) AS token FROM {derived_sql('messy_amounts')}",
)
def clean_amount(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    return amounts.with_tokens(df.select("ord", "k", "amt"), {"token": "amt"})


@query(
    "fold_fullwidth",
    f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '(12)...' || {TOTAL}
        ELSE '(' || {TOTAL} || ')' END AS folded FROM orders""",
)
def fold_fullwidth(spark, sf_dir):
    raw = F.expr(
        f"""CASE o_orderkey % 4 WHEN 0 THEN '（' || {FULLWIDTH} || '）'
        WHEN 1 THEN '(' || {TOTAL} || ')' WHEN 2 THEN '⁽' || {FULLWIDTH} || '﹚' ELSE '⑿…' || {TOTAL} END"""
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.fold_fullwidth(raw).alias("folded"))


@query("paren_negative", f"SELECT id, want AS token FROM {derived_sql('odd_amounts')}")
def paren_negative(spark, sf_dir):
    df = derived(spark, sf_dir, "odd_amounts")
    return df.select("id", amounts.clean_amount(F.col("raw")).alias("token"))


@query(
    "is_amount",
    f"""SELECT id, CASE id % 50 WHEN 6 THEN NULL ELSE id % 50 NOT IN (1, 2, 3, 4) END AS valid
        FROM {derived_sql('invalid_amounts')}""",
)
def is_amount(spark, sf_dir):
    df = derived(spark, sf_dir, "invalid_amounts")
    tokens = amounts.with_tokens(df.select("id", "price"), {"token": "price"})
    return tokens.select("id", amounts.is_amount(F.col("token")).alias("valid"))


# Some rows as wide as amounts may be, and some with more decimals than their type has.
@query(
    "parse_amount",
    f"""SELECT id, CASE WHEN id % 50 IN (7, 8) THEN CAST(CASE id % 50 WHEN 7 THEN '1234567890123456789012345678.' || id % 10
                ELSE '-0.00000000005' END AS DECIMAL(38,10))
            WHEN id % 50 NOT IN (1, 2, 3, 4, 6) THEN CAST(price AS DECIMAL(38,10)) END AS amount
        FROM {derived_sql('invalid_amounts')}""",
)
def parse_amount(spark, sf_dir):
    wide = "CASE id % 50 WHEN 7 THEN '1234567890123456789012345678.' || id % 10 WHEN 8 THEN '(0.00000000005)' ELSE price END"
    df = derived(spark, sf_dir, "invalid_amounts").select("id", F.expr(wide).alias("price"))
    return amounts.with_amounts(df, {"amount": "price"}).select("id", "amount")


EIGHTH = """CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.125 AS DECIMAL(4,3))
    * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS DECIMAL(38,10))"""


@query(
    "round_half_up",
    f"""SELECT o_orderkey, coalesce(CAST(round({EIGHTH}, 2) AS DOUBLE), 0) AS rounded FROM orders""",
)
def round_half_up(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", amounts.round_half_up(F.expr(EIGHTH)).alias("rounded"))


@query("text_normalise", f"SELECT id, stripped FROM {derived_sql('messy_text')}")
def text_normalise(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_text")
    return df.select("id", text.normalise_text(F.col("raw")).alias("stripped"))


@query("strip_all_space", f"SELECT id, squeezed FROM {derived_sql('messy_text')}")
def strip_all_space(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_text")
    return df.select("id", text.strip_all_space(F.col("raw")).alias("squeezed"))


ROWS = group.ROWS_COLUMN
MESSY = derived_sql("messy_amounts")
CLEAN = f"""(SELECT CAST(k AS STRING) AS k, ord, want, rf, ls, trim(sm, ' 　') AS sm FROM {MESSY})"""


def _joined(key: str, value: str, sep: str = "；") -> str:
    """First-seen distinct join of one column, as a subquery (key, column)."""
    return f"""(SELECT {key}, string_agg({value}, '{sep}' ORDER BY first, {value}) AS {value} FROM
        (SELECT {key}, {value}, min(ord) AS first FROM {CLEAN} WHERE {value} <> '' GROUP BY ALL)
        GROUP BY {key})"""


@query("group_count", f'SELECT rf AS k, count(*) AS "{ROWS}" FROM {CLEAN} GROUP BY rf')
def group_count(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    padded = df.select(F.concat(F.lit("　 "), "rf", F.lit("\t")).alias("k"))
    return group.group_count(padded, "k")


# Beside the messy amounts, a column of wide values and one of 13 decimals, which only
# the total may round: 1000 times the sum fits the type of either side.
@query(
    "decimal_sum",
    f"""SELECT k, CAST(coalesce(sum(want), 0) AS DECIMAL(38,10)) AS total,
            CAST(sum(CAST('1234567890123456789012' AS DECIMAL(38,10)) + ord) AS DECIMAL(38,10)) AS wide,
            CAST(sum(CAST('0.0000000000004' AS DECIMAL(28,13)) * (1 + ord % 2)) AS DECIMAL(38,10)) AS fine
        FROM {CLEAN} GROUP BY k""",
)
def decimal_sum(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    wide = F.concat(F.lit("¥"), (F.lit("1234567890123456789012").cast("decimal(38,0)") + F.col("ord")).cast("string"))
    fine = F.when(F.col("ord") % 2 == 0, "0.0000000000004").otherwise("０.0000000000008")
    sums = group.decimal_sum(df.withColumn("wide", wide).withColumn("fine", fine), "k", ["amt", "wide", "fine"])
    return sums.withColumnRenamed("amt", "total")


# Amounts of 40 digits and of 35 decimals of either sign; their totals are put together
# from parts that SQL can hold, so they are compared as text.
@query(
    "exact_sum",
    f"""SELECT k, rtrim(rtrim(CAST(CAST(coalesce(sum(want), 0) AS DECIMAL(38,10)) AS VARCHAR), '0'), '.') AS total,
            CAST(count(*) * CAST('12345678901234567890' AS HUGEINT) AS VARCHAR) || lpad(CAST(sum(ord) AS VARCHAR), 20, '0') AS wide,
            '-0.' || rtrim(lpad(CAST(sum(ord + 1) AS VARCHAR), 35, '0'), '0') AS fine
        FROM {CLEAN} GROUP BY k""",
)
def exact_sum(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    wide = F.concat(F.lit("$12,345,678,901,234,567,890"), F.lpad(F.col("ord").cast("string"), 20, "0"))
    fine = F.concat(F.lit("（.00000"), F.lpad((F.col("ord") + 1).cast("string"), 30, "0"), F.lit("）"))
    sums = group.exact_sum(df.withColumn("wide", wide).withColumn("fine", fine), "k", ["amt", "wide", "fine"])
    return sums.withColumnRenamed("amt", "total")


@query(
    "unique_join",
    f"""SELECT k, coalesce(sm, '') AS sm FROM (SELECT DISTINCT k FROM {CLEAN}) LEFT JOIN {_joined('k', 'sm', ' | ')} USING (k)""",
)
def unique_join(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    return group.unique_join(df, "k", "sm", ["ord"], sep='" | "')


GROUP_ORACLE = f"""
    SELECT n AS "{ROWS}", k, amt, coalesce(rf, '') AS rf, coalesce(ls, '') AS ls, coalesce(sm, '') AS sm
    FROM (SELECT k, count(*) AS n, CAST(round(coalesce(sum(want), 0), 2) AS DOUBLE) AS amt FROM {CLEAN} GROUP BY k)
    LEFT JOIN {_joined('k', 'rf')} USING (k)
    LEFT JOIN {_joined('k', 'ls')} USING (k)
    LEFT JOIN {_joined('k', 'sm')} USING (k)"""


@query("group_aggregate", GROUP_ORACLE)
def group_aggregate(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts").drop("want")
    return group.group_aggregate(df, "k", ["amt"], ["ord"])


@query(
    "group_aggregate_text_only",
    f"""SELECT n AS "{ROWS}", rf, coalesce(k, '') AS k, coalesce(sm, '') AS sm
        FROM (SELECT rf, count(*) AS n FROM {CLEAN} GROUP BY rf)
        LEFT JOIN {_joined('rf', 'k')} USING (rf) LEFT JOIN {_joined('rf', 'sm')} USING (rf)""",
)
def group_aggregate_text_only(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    return group.group_aggregate(df, "rf", [], ["ord"], columns=["k", "sm"])


@query(
    "long_cells",
    f"""WITH cells AS (SELECT 'ls' AS c, rf, ls AS v, ord FROM {CLEAN} UNION ALL SELECT 'sm', rf, sm, ord FROM {CLEAN}),
        seen AS (SELECT c, rf, v, min(ord) AS first, strlen(v) + 3 AS bytes FROM cells WHERE v <> '' GROUP BY ALL),
        placed AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY c, rf ORDER BY first, v
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seen)
        SELECT rf, c AS "column", CAST(before // 100 + 1 AS BIGINT) AS part,
            string_agg(v, '；' ORDER BY first, v) AS text
        FROM placed GROUP BY ALL""",
)
def long_cells(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    return group.long_cells(df, "rf", ["ls", "sm"], ["ord"], part_bytes=100)


@query(
    "first_seen_order",
    f"""SELECT k, first_seen, row_number() OVER (ORDER BY first_seen, k) AS position
        FROM (SELECT k, min(ord) AS first_seen FROM {MESSY} GROUP BY k)""",
)
def first_seen_order(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    pad = F.when(F.col("ord") % 2 == 0, F.lit("　 ")).otherwise("")
    padded = df.select(F.concat(pad, F.col("k").cast("string"), pad).alias("k"), "ord")
    return ranking.first_seen_order(padded, "k", ["ord"]).withColumn("k", F.col("k").cast("long"))


@query(
    "validate_columns",
    f"""SELECT 'price' AS "column", count_if(id % 50 IN (1, 2, 3, 4)) AS bad_values,
            count_if(id % 50 IN (1, 2, 3, 4)) = 0 AS ok FROM {derived_sql('invalid_amounts')}
        UNION ALL SELECT 'cust', 0, true
        UNION ALL SELECT 'status', count(*), count(*) = 0 FROM orders""",
)
def validate_columns(spark, sf_dir):
    return validate.validate_columns(derived(spark, sf_dir, "invalid_amounts"), ["price", "cust", "status"])


@query(
    "invalid_samples",
    f"""SELECT * FROM (
        SELECT 'price' AS "column", row_number() OVER (ORDER BY id) AS sample, price AS raw, price AS token
        FROM {derived_sql('invalid_amounts')} WHERE id % 50 IN (1, 2, 3, 4)
        UNION ALL
        SELECT 'status', row_number() OVER (ORDER BY id), status, status FROM {derived_sql('invalid_amounts')})
        WHERE sample <= 5""",
)
def invalid_samples(spark, sf_dir):
    return validate.invalid_samples(
        derived(spark, sf_dir, "invalid_amounts"), ["price", "cust", "status"], ["id"]
    )


@query(
    "run_totals",
    f"SELECT count(*) AS rows_before, count(DISTINCT k) AS rows_after FROM {CLEAN}",
)
def run_totals(spark, sf_dir):
    df = derived(spark, sf_dir, "messy_amounts")
    return group.run_totals(df, group.group_count(df, "k"))
