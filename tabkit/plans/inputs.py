"""Messy inputs derived from the given tables.

Each is a table name and select expressions in the common subset of Spark SQL and
DuckDB, so that a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabkit.lookups import TEXT_MISSING

PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
TOTAL = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
FULLWIDTH = f"translate({TOTAL}, '0123456789.', '０１２３４５６７８９．')"

INPUTS: dict[str, tuple[str, list[str]]] = {
    "messy_amounts": (
        "lineitem",
        [
            "l_suppkey AS k",
            "l_orderkey * 100 + l_linenumber AS ord",
            f"""CASE l_linenumber % 5
                WHEN 0 THEN '（' || {PRICE} || '）'
                WHEN 1 THEN '¥ ' || {PRICE}
                WHEN 2 THEN '$' || {PRICE}
                WHEN 3 THEN '−' || {PRICE}
                ELSE 'N/A' END AS amt""",
            f"""CASE l_linenumber % 5
                WHEN 0 THEN -CAST(l_extendedprice AS DECIMAL(18,2))
                WHEN 3 THEN -CAST(l_extendedprice AS DECIMAL(18,2))
                WHEN 4 THEN NULL
                ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS want""",
            "l_returnflag AS rf",
            "l_linestatus AS ls",
            "CASE WHEN l_quantity < 5 THEN ' ' ELSE ' ' || substr(CAST(l_shipdate AS STRING), 1, 7) || '　' END AS sm",
        ],
    ),
    "odd_amounts": (
        "orders",
        [
            "o_orderkey AS id",
            f"""CASE o_orderkey % 16
                WHEN 0 THEN '(' || {TOTAL} || ')'
                WHEN 1 THEN ' ( -' || {TOTAL} || ' ) '
                WHEN 2 THEN '(+' || {TOTAL} || ')'
                WHEN 3 THEN '（' || {FULLWIDTH} || '）'
                WHEN 4 THEN '(' || {TOTAL}
                WHEN 5 THEN {TOTAL} || ')'
                WHEN 6 THEN '()'
                WHEN 7 THEN '$(' || {TOTAL} || ')'
                WHEN 8 THEN '- ' || {TOTAL}
                WHEN 9 THEN '￥' || {FULLWIDTH}
                WHEN 10 THEN '1,2,3，' || {TOTAL}
                WHEN 11 THEN '⑴'
                WHEN 12 THEN '—'
                WHEN 13 THEN ' NaN '
                WHEN 14 THEN '+ ' || {TOTAL} || '　元'
                ELSE CAST(NULL AS STRING) END AS raw""",
            f"""CASE o_orderkey % 16
                WHEN 0 THEN '-' || {TOTAL}
                WHEN 1 THEN '-' || {TOTAL}
                WHEN 2 THEN '-' || {TOTAL}
                WHEN 3 THEN '-' || {TOTAL}
                WHEN 4 THEN '(' || {TOTAL}
                WHEN 5 THEN {TOTAL} || ')'
                WHEN 7 THEN '(' || {TOTAL} || ')'
                WHEN 8 THEN '-' || {TOTAL}
                WHEN 9 THEN {TOTAL}
                WHEN 10 THEN '123' || {TOTAL}
                WHEN 11 THEN '-1'
                WHEN 14 THEN '+' || {TOTAL} || '元'
                ELSE CAST(NULL AS STRING) END AS want""",
        ],
    ),
    "invalid_amounts": (
        "orders",
        [
            "o_orderkey AS id",
            f"""CASE o_orderkey % 50
                WHEN 1 THEN '12%'
                WHEN 2 THEN '1e5'
                WHEN 3 THEN '5.'
                WHEN 4 THEN 'abc'
                WHEN 5 THEN '.38'
                WHEN 6 THEN '$-'
                ELSE {TOTAL} END AS price""",
            "CAST(o_custkey AS STRING) AS cust",
            "o_orderstatus AS status",
        ],
    ),
    "messy_text": (
        "customer",
        [
            "c_custkey AS id",
            """CASE c_custkey % 7
                WHEN 0 THEN '　' || c_name || ' '
                WHEN 1 THEN substr(c_name, 1, 4) || '　' || substr(c_name, 5)
                WHEN 2 THEN '\t ' || substr(c_name, 1, 4) || ' ​' || substr(c_name, 5) || '\t'
                WHEN 3 THEN '﻿' || c_name
                WHEN 4 THEN c_name
                WHEN 5 THEN '  '
                ELSE CAST(NULL AS STRING) END AS raw""",
            """CASE c_custkey % 7
                WHEN 1 THEN substr(c_name, 1, 4) || '　' || substr(c_name, 5)
                WHEN 2 THEN substr(c_name, 1, 4) || ' ​' || substr(c_name, 5)
                WHEN 3 THEN '﻿' || c_name
                WHEN 5 THEN ''
                WHEN 6 THEN ''
                ELSE c_name END AS stripped""",
            """CASE c_custkey % 7 WHEN 5 THEN '' WHEN 6 THEN CAST(NULL AS STRING) ELSE c_name END AS squeezed""",
        ],
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = INPUTS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def derived_sql(name: str) -> str:
    source, columns = INPUTS[name]
    return f"(SELECT {', '.join(columns)} FROM {source})"


PART_HEADER = "p_partkey|p_name|p_brand|p_type|p_size"
_PART = ["CAST(p_partkey AS STRING)", "p_name", "p_brand", "p_type", "CAST(p_size AS STRING)"]


def part_line(mark: str, columns=_PART) -> str:
    return f" || '{mark}' || ".join(columns)


TOKENS = [t for t in TEXT_MISSING if t]
PATH = """'/f f/' || CAST(page_id % 7 AS STRING) || '/' || CASE page_id % 13
    WHEN 11 THEN '.hidden' || CAST(page_id AS STRING)
    WHEN 12 THEN CAST(page_id AS STRING) || '.'
    ELSE CAST(page_id AS STRING) END || CASE page_id % 13
    WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp3' WHEN 3 THEN '.mkv'
    WHEN 4 THEN '.tar.gz' WHEN 5 THEN '.GDB' WHEN 6 THEN '.ais' WHEN 7 THEN '.tplus'
    WHEN 8 THEN '.sqlite' WHEN 9 THEN '.exe' WHEN 10 THEN '.xyz' ELSE '' END"""
EXT = """CASE page_id % 13
    WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp3' WHEN 3 THEN '.mkv'
    WHEN 4 THEN '.gz' WHEN 5 THEN '.GDB' WHEN 6 THEN '.ais' WHEN 7 THEN '.tplus'
    WHEN 8 THEN '.sqlite' WHEN 9 THEN '.exe' WHEN 10 THEN '.xyz' ELSE '' END"""
CATEGORY = """CASE page_id % 13
    WHEN 0 THEN '办公文档' WHEN 1 THEN '图片' WHEN 2 THEN '音频' WHEN 3 THEN '视频'
    WHEN 4 THEN '压缩包' WHEN 5 THEN '财务账套' WHEN 6 THEN '财务账套' WHEN 7 THEN '财务账套'
    WHEN 8 THEN '数据库' WHEN 9 THEN '可执行文件' ELSE '其他' END"""

INPUTS |= {
    "part_lines": (
        "part",
        [
            "p_partkey AS line_id",
            f"""CASE p_partkey % 10
                WHEN 3 THEN {part_line('|')} || '|extra'
                WHEN 4 THEN {part_line('|', [*_PART[:3], "'NA'", _PART[4]])}
                WHEN 5 THEN {part_line('|', _PART[:3])}
                WHEN 6 THEN '||||'
                WHEN 7 THEN ''
                WHEN 8 THEN '   '
                WHEN 9 THEN {part_line('|', [_PART[0], "' ' || p_name || '\"'", *_PART[2:]])}
                ELSE {part_line('|')} END AS line""",
        ],
    ),
    "blank_lines": (
        "customer",
        [
            "c_custkey AS line_id",
            """CASE c_custkey % 5
                WHEN 0 THEN '  ' || CAST(c_custkey AS STRING) || ' \t ' || c_name || '　' || c_mktsegment || ' '
                WHEN 1 THEN CAST(c_custkey AS STRING) || ' ' || c_name || ' ' || c_mktsegment
                WHEN 2 THEN c_name || '  '
                WHEN 3 THEN ' \t　'
                ELSE CAST(c_custkey AS STRING) || '\t\t' || c_name || ' ' || c_mktsegment END AS line""",
            """CASE c_custkey % 5
                WHEN 2 THEN c_name
                WHEN 3 THEN ''
                ELSE CAST(c_custkey AS STRING) || '~' || c_name || '~' || c_mktsegment END AS want""",
            "CASE c_custkey % 5 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 3 END AS width",
        ],
    ),
    "token_texts": (
        "orders",
        [
            "o_orderkey AS id",
            "CASE o_orderkey % 25 "
            + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOKENS))
            + " WHEN 18 THEN '' WHEN 19 THEN ' NA' WHEN 20 THEN 'Na' WHEN 21 THEN '-' "
            "WHEN 22 THEN CAST(NULL AS STRING) ELSE o_orderpriority END AS raw",
            """CASE WHEN o_orderkey % 25 <= 18 OR o_orderkey % 25 = 22 THEN ''
                WHEN o_orderkey % 25 = 19 THEN ' NA' WHEN o_orderkey % 25 = 20 THEN 'Na'
                WHEN o_orderkey % 25 = 21 THEN '-' ELSE o_orderpriority END AS want""",
        ],
    ),
    "file_names": (
        "pages",
        [
            f"{PATH} AS path",
            "page_id * 131072 AS length",
            "CAST(NULL AS TIMESTAMP) AS created",
            "TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' SECOND AS modified",
            "page_id",
        ],
    ),
    "file_wants": (
        "pages",
        [
            f"{PATH} AS path",
            "'/f f/' || CAST(page_id % 7 AS STRING) AS folder",
            f"substr({PATH}, 8) AS name",
            f"{EXT} AS ext",
            f"{CATEGORY} AS category",
            "page_id",
        ],
    ),
}
