"""Queries over delimited lines and text trees, and their oracles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit import convert, sinks, streaming
from tabkit.functions import separators
from tabkit.functions.files import relative_output_path
from tabkit.functions.text import blank_missing
from tabkit.operators import delimited, ranking
from tabkit.plans.inputs import PART_HEADER, PATH, derived, derived_sql, table
from tabkit.plans.registry import query
from tabkit.session import scratch_path
from tabkit.sources import tables, text_tree
from tabkit.sources.file_tree import list_files, tree_root

PIPE = separators.Separator("literal", "|")
HEADER = PART_HEADER.split("|")
PART_LINES = derived_sql("part_lines")


@query(
    "scan_as_text",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
        regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') AS o_totalprice,
        CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""",
)
def scan_as_text(spark, sf_dir):
    return tables.as_text(table(spark, sf_dir, "orders"))


def part_rows(spark, sf_dir):
    lines = derived(spark, sf_dir, "part_lines")
    return delimited.split_rows(_as_file(lines), PIPE)


def _as_file(lines: DataFrame) -> DataFrame:
    """Lines of one file whose header is known and not among them."""
    return lines.select(
        F.lit("part").alias("path"),
        F.lit(0).cast("long").alias("block"),
        "line_id",
        "line",
        F.lit("|").alias("separator"),
        F.array(*[F.lit(c) for c in HEADER]).alias("header"),
        F.lit(PART_HEADER).alias("header_line"),
        F.lit(-1).cast("long").alias("header_block"),
        F.lit(-1).cast("long").alias("header_line_id"),
    )


@query(
    "split_literal",
    f"""SELECT line_id, replace(line, '|', '~') AS fields,
        CAST(length(line) - length(replace(line, '|', '')) + 1 AS INTEGER) AS width FROM {PART_LINES}""",
)
def split_literal(spark, sf_dir):
    fields = separators.split_fields(F.col("line"), separators.separator_spec("|"))
    lines = derived(spark, sf_dir, "part_lines")
    return lines.select("line_id", F.array_join(fields, "~").alias("fields"), F.size(fields).alias("width"))


@query("split_whitespace", f"SELECT line_id, want AS fields, width FROM {derived_sql('blank_lines')}")
def split_whitespace(spark, sf_dir):
    fields = separators.split_fields(F.col("line"), separators.separator_spec("空白"))
    lines = derived(spark, sf_dir, "blank_lines")
    return lines.select("line_id", F.array_join(fields, "~").alias("fields"), F.size(fields).alias("width"))


@query(
    "split_with_header",
    """SELECT p_partkey AS line_id,
        CASE p_partkey % 10 WHEN 6 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS p_partkey,
        CASE p_partkey % 10 WHEN 6 THEN '' WHEN 9 THEN ' ' || p_name || '"' ELSE p_name END AS p_name,
        CASE p_partkey % 10 WHEN 6 THEN '' ELSE p_brand END AS p_brand,
        CASE WHEN p_partkey % 10 IN (4, 5, 6) THEN '' ELSE p_type END AS p_type,
        CASE WHEN p_partkey % 10 IN (5, 6) THEN '' ELSE CAST(p_size AS VARCHAR) END AS p_size
        FROM part WHERE p_partkey % 10 NOT IN (3, 7, 8)""",
)
def split_with_header(spark, sf_dir):
    lines = derived(spark, sf_dir, "part_lines").withColumn("line_id", F.col("line_id") + 1)
    lines = lines.unionByName(spark.createDataFrame([(0, PART_HEADER)], "line_id long, line string"))
    one_file = lines.select(F.lit("part").alias("uri"), F.lit(0).cast("long").alias("block"), "line_id", "line")
    files, split = convert.parse_lines(one_file, PIPE)
    rows = delimited.kept_rows(split).select((F.col("line_id") - 1).alias("line_id"), "fields")
    return delimited.name_fields(rows, files.first()["header"], keep=["line_id"])


@query("skip_blank_lines", f"SELECT line_id, line FROM {PART_LINES} WHERE trim(line) <> ''")
def skip_blank_lines(spark, sf_dir):
    return derived(spark, sf_dir, "part_lines").filter(~separators.is_blank_line(F.col("line"), PIPE))


@query(
    "skip_bad_rows",
    """SELECT p_partkey AS line_id, CASE p_partkey % 10
        WHEN 4 THEN concat_ws('~', p_partkey, p_name, p_brand, '', p_size)
        WHEN 5 THEN concat_ws('~', p_partkey, p_name, p_brand, '', '')
        WHEN 6 THEN '~~~~'
        WHEN 9 THEN concat_ws('~', p_partkey, ' ' || p_name || '"', p_brand, p_type, p_size)
        ELSE concat_ws('~', p_partkey, p_name, p_brand, p_type, p_size) END AS fields
        FROM part WHERE p_partkey % 10 NOT IN (3, 7, 8)""",
)
def skip_bad_rows(spark, sf_dir):
    rows = delimited.accepted_rows(part_rows(spark, sf_dir))
    return rows.select("line_id", F.array_join("fields", "~").alias("fields"))


@query(
    "rejected_rows",
    f"""SELECT 'part' AS path, 0 AS block, line_id, line, CAST(6 AS INTEGER) AS n_fields, CAST(5 AS INTEGER) AS expected
        FROM {PART_LINES} WHERE line_id % 10 = 3""",
)
def rejected_rows(spark, sf_dir):
    return delimited.rejected_rows(part_rows(spark, sf_dir))


@query("blank_missing_tokens", f"SELECT id, want AS text FROM {derived_sql('token_texts')}")
def blank_missing_tokens(spark, sf_dir):
    df = derived(spark, sf_dir, "token_texts")
    return df.select("id", blank_missing(F.col("raw")).alias("text"))


@query(
    "header_repair",
    """WITH h AS (SELECT p_partkey, [p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END,
            p_brand, '', p_name, p_type] AS l FROM part)
        SELECT p_partkey, array_to_string(list_transform(range(1, 8), lambda i:
            CASE WHEN l[i] = '' THEN 'Unnamed: ' || (i - 1)
            WHEN len(list_filter(l[1:i - 1], lambda y: y = l[i])) = 0 THEN l[i]
            ELSE l[i] || '.' || len(list_filter(l[1:i - 1], lambda y: y = l[i])) END), '~') AS names FROM h""",
)
def header_repair(spark, sf_dir):
    header = F.expr("array(p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, p_brand, '', p_name, p_type)")
    parts = table(spark, sf_dir, "part").select("p_partkey", header.alias("header"))
    named = delimited.with_repaired_names(parts)
    return named.select("p_partkey", F.array_join("names", "~").alias("names"))


# One file per 500 parts, each with its header line, its own separator by file number,
# and every seventh of them blank.
MARKS = "CASE file % 5 WHEN 0 THEN '\t' WHEN 1 THEN '|' WHEN 2 THEN ',' WHEN 3 THEN ';' ELSE '  ' END"
LABELS = "CASE file % 5 WHEN 0 THEN '\t' WHEN 1 THEN '|' WHEN 2 THEN ',' WHEN 3 THEN ';' ELSE 'whitespace' END"


def separated_lines(spark, sf_dir) -> DataFrame:
    """``(file, line_id, line)``"""
    parts = table(spark, sf_dir, "part").selectExpr(
        "CAST(floor(p_partkey / 500) AS BIGINT) AS file",
        "p_partkey AS line_id",
        "array(CAST(p_partkey AS STRING), replace(p_name, ' ', '_'), p_brand, p_type, CAST(p_size AS STRING)) AS cells",
    )
    header = F.array(*[F.lit(c) for c in HEADER])
    headers = parts.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line_id"), header.alias("cells"))
    lines = parts.unionByName(headers).withColumn("mark", F.expr(MARKS))
    line = F.when(F.col("file") % 7 == 6, "  ").otherwise(F.array_join("cells", "\x00"))
    # array_join takes a literal; the mark differs by row.
    return lines.select("file", "line_id", F.replace(line, F.lit("\x00"), F.col("mark")).alias("line"))


def write_text_tree(lines: DataFrame, path: str) -> None:
    """One physical file per value of ``file``, its lines in the order of ``line_id``."""
    (
        lines.repartition("file")
        .sortWithinPartitions("file", "line_id")
        .select("file", "line")
        .write.partitionBy("file")
        .text(path)
    )


def file_number(path):
    """The number in a path of :func:`write_text_tree`; null for the folder of null."""
    return F.regexp_extract(path, "file=(-?[0-9]+)/", 1).try_cast("long")


FILES = """(SELECT CAST(floor(p_partkey / 500) AS BIGINT) AS file, count(*) AS n FROM part GROUP BY ALL)"""


@query(
    "scan_delimited_tree",
    """SELECT CAST(floor(p_partkey / 500) AS BIGINT) AS file, CAST(p_partkey AS VARCHAR) AS p_partkey,
        replace(p_name, ' ', '_') AS p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size
        FROM part WHERE CAST(floor(p_partkey / 500) AS BIGINT) % 7 <> 6""",
)
def scan_delimited_tree(spark, sf_dir):
    root = scratch_path(spark, "tree")
    write_text_tree(separated_lines(spark, sf_dir), root)
    rows = convert.read_delimited_tree(spark, root).table(HEADER, keep=["path"])
    return rows.withColumn("file", file_number(F.col("path"))).drop("path")


TREE_ROWS = """SELECT CAST(floor(p_partkey / 500) AS BIGINT) AS file, CAST(p_partkey AS VARCHAR) AS p_partkey,
        replace(p_name, ' ', '_') AS p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size
        FROM part WHERE CAST(floor(p_partkey / 500) AS BIGINT) % 7 <> 6"""


def part_tree(spark, sf_dir) -> str:
    root = scratch_path(spark, "tree")
    write_text_tree(separated_lines(spark, sf_dir), root)
    return root


@query("nested_output", TREE_ROWS)
def nested_output(spark, sf_dir):
    out = scratch_path(spark, "nested")
    sinks.write_nested(convert.read_delimited_tree(spark, part_tree(spark, sf_dir)), out)
    schema = ", ".join(f"{name} string" for name in HEADER)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("header", True).csv(out)
    return rows.select(file_number(F.col("_metadata.file_path")).alias("file"), *HEADER)


@query("header_tables", TREE_ROWS)
def header_tables(spark, sf_dir):
    tree = convert.read_delimited_tree(spark, part_tree(spark, sf_dir))
    path = next(path for path, names in sinks.write_tables(tree, scratch_path(spark, "tables")) if names == HEADER)
    rows = spark.read.parquet(path)
    # A path is as below the root and without its extension: 'file=3/part-...'.
    return rows.select(file_number(F.col("rel_path")).alias("file"), *HEADER)


@query("resumable_chunks", TREE_ROWS)
def resumable_chunks(spark, sf_dir):
    root, out = part_tree(spark, sf_dir), scratch_path(spark, "chunks")
    streaming.convert_chunks(spark, root, out, scratch_path(spark, "progress"), files_per_chunk=100)
    cells = [F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(HEADER)]
    return streaming.read_chunks(spark, out).select(file_number(F.col("path")).alias("file"), *cells)


@query(
    "detect_separator",
    f"""SELECT file, CASE WHEN file % 7 <> 6 THEN {LABELS} END AS separator,
        CASE WHEN file % 7 <> 6 THEN 5 ELSE -1 END AS n_columns,
        CASE WHEN file % 7 <> 6 THEN 'ok' ELSE 'failed' END AS status, n + 1 AS n_lines FROM {FILES}""",
)
def detect_separator(spark, sf_dir):
    lines = separated_lines(spark, sf_dir).select(
        F.col("file").cast("string").alias("uri"), F.lit(0).cast("long").alias("block"), "line_id", "line"
    )
    files, _ = convert.parse_lines(lines)
    return files.select(
        F.col("path").cast("long").alias("file"),
        "separator",
        F.coalesce(F.size("header"), F.lit(-1)).alias("n_columns"),
        "status",
        "n_lines",
    )


# Of the listed files every fourth has lost its end since, and one more is gone.
@query(
    "convert_status",
    f"""SELECT separator, encoding, count(*) AS total, count_if(ok) AS ok, count_if(NOT ok) AS failed
        FROM (SELECT CASE WHEN file % 4 <> 2 AND file % 7 <> 6 THEN {LABELS} END AS separator,
                CASE WHEN file % 4 <> 2 THEN 'utf-8' END AS encoding, file % 4 <> 2 AND file % 7 <> 6 AS ok FROM {FILES}
              UNION ALL SELECT NULL, NULL, false FROM {FILES} WHERE file % 4 = 1)
        GROUP BY ALL""",
)
def convert_status(spark, sf_dir):
    root = scratch_path(spark, "tree")
    write_text_tree(separated_lines(spark, sf_dir), root)
    listing = list_files(spark, root).filter(F.lower("path").endswith(".txt"))
    kind = file_number(F.col("path")) % 4
    longer = listing.withColumn("length", F.when(kind == 2, F.col("length") + 10).otherwise(F.col("length")))
    gone = listing.filter(kind == 1).withColumn("path", F.concat("path", F.lit(".gone.txt")))
    status = convert.read_listed(longer.unionByName(gone), tree_root(spark, root)).status
    return delimited.status_totals(status.groupBy("separator", "encoding"))


@F.pandas_udf(T.BinaryType())
def _gb18030(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: text.encode("gb18030"))


# Files of 50 documents, in turn UTF-8, GB18030 and Latin-1. The last begin with a letter
# whose byte GB18030 does not know, and have only letters of their own set.
DOC_FILE = "CAST(floor(doc_id / 50) AS BIGINT)"
LATIN_TEXT = "'ÿ' || regexp_replace(text, '[^\\x01-\\xff]', '?'{all})"


@query(
    "encoding_resolve",
    f"""WITH texts AS (SELECT {DOC_FILE} AS file, CASE WHEN {DOC_FILE} % 3 = 2
                THEN {LATIN_TEXT.replace("{all}", ", 'g'")} ELSE text END AS text FROM documents),
        lines AS (SELECT file,
            unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line
            FROM texts)
        SELECT file, CASE WHEN file % 3 = 2 THEN 'latin1' WHEN file % 3 = 0 OR high = 0 THEN 'utf-8' ELSE 'gb18030' END
            AS encoding, line
        FROM lines JOIN (SELECT file, count_if(strlen(line) <> length(line)) AS high FROM lines GROUP BY file) USING (file)""",
)
def encoding_resolve(spark, sf_dir):
    root = scratch_path(spark, "documents")
    docs = table(spark, sf_dir, "documents").select(F.expr(DOC_FILE).alias("file"), F.col("doc_id").alias("line_id"), "text")
    latin = F.encode(F.concat(F.lit("ÿ"), F.regexp_replace("text", "[^\\x01-\\xff]", "?")), "ISO-8859-1")
    # Of a negative number the remainder is negative.
    forms = {"= 0": F.col("text"), "NOT IN (0, 2)": _gb18030("text").cast("string"), "= 2": latin.cast("string")}
    parts = [docs.filter(f"file % 3 {which}").select("file", "line_id", c.alias("line")) for which, c in forms.items()]
    write_text_tree(parts[0].unionByName(parts[1]).unionByName(parts[2]), root)
    lines = text_tree.read_lines(text_tree.reading_session(spark), root)
    files = convert.resolve_files(lines)
    decoded = text_tree.decode_lines(lines.join(files, "uri"), only_utf8=False)
    return decoded.select(file_number(F.col("uri")).alias("file"), "encoding", "line")


FIRST_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


@query(
    "first_n_per_group",
    f"""SELECT * FROM (SELECT l_suppkey, {', '.join(FIRST_ORDER)},
        CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(FIRST_ORDER)}) AS INTEGER) AS row_in_group
        FROM lineitem) WHERE row_in_group <= 50""",
)
def first_n_per_group(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", *FIRST_ORDER)
    return ranking.first_n_per_group(df, ["l_suppkey"], FIRST_ORDER, 50)


@query("preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def preview(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.preview(df, ["o_totalprice", "o_orderkey"], 100)


@query(
    "union_chunks",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""",
)
def union_chunks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    chunks = [orders.filter("o_orderstatus < 'O'"), orders.filter("o_orderstatus >= 'O'").select(*orders.columns[::-1])]
    return delimited.union_chunks(chunks)


@query(
    "relative_output_path",
    f"""SELECT path, CASE WHEN ext = '' THEN substr(path, 6) ELSE substr(path, 6, length(path) - 5 - length(ext)) END
        AS rel_path FROM {derived_sql('file_wants')}""",
)
def relative_path(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.expr(PATH).alias("path"))
    return files.select("path", relative_output_path(F.col("path"), "/f f").alias("rel_path"))
