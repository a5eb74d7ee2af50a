"""Queries over file records and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit import inventory, sinks
from tabkit.functions import files
from tabkit.lookups import AUDIT_COLUMNS, INVENTORY_COLUMNS, SCAN_OK, SUMMARY_COLUMNS, TOTAL_LABEL
from tabkit.operators import parts
from tabkit.plans.delimited import file_number, write_text_tree
from tabkit.plans.inputs import derived, derived_sql, table
from tabkit.plans.registry import query
from tabkit.session import scratch_path
from tabkit.sources.file_tree import list_files, read_heads

WANTS = derived_sql("file_wants")
LIMIT = 20
SIZE = "CAST(round_even(page_id * 0.125, 2) AS DECIMAL(18,2))"
# One file for every 50 documents, with a folder of its own.
DOC_FILES = "(SELECT CAST(floor(doc_id / 50) AS BIGINT) AS file, sum(strlen(text) + 1) AS bytes FROM documents GROUP BY ALL)"


@query(
    "file_inventory",
    f"""SELECT file, 'part-' AS name, '.txt' AS ext, 'file=' || file AS folder,
        round_even(bytes / 1048576, 2) AS size_mb, true AS has_time, '办公文档' AS category, 'unknown' AS detected
        FROM {DOC_FILES}""",
)
def file_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "inventory")
    write_text_tree(docs.selectExpr("CAST(floor(doc_id / 50) AS BIGINT) AS file", "doc_id AS line_id", "text AS line"), root)
    records, _ = inventory.scan_tree(spark, root)
    records = records.filter("ext = '.txt' AND name LIKE 'part-%'")
    records = records.withColumn("file", file_number(F.col("path")))
    return records.select(
        "file",
        F.substring("name", 1, 5).alias("name"),
        "ext",
        F.when(F.col("file").isNotNull(), F.substring_index("folder", "/", -1)).alias("folder"),
        "size_mb",
        F.col("modified").isNotNull().alias("has_time"),
        "category",
        "detected",
    )


@query("path_parts", f"SELECT path, folder, name, ext FROM {WANTS}")
def path_parts(spark, sf_dir):
    path = F.col("path")
    name = files.name_of(path)
    df = derived(spark, sf_dir, "file_names")
    return df.select(
        path, files.folder_of(path).alias("folder"), name.alias("name"), files.suffix_of(name).alias("ext")
    )


@query("size_mb", "SELECT page_id, CAST(round_even(page_id * 0.125, 2) AS DOUBLE) AS size_mb FROM pages")
def size_mb(spark, sf_dir):
    return derived(spark, sf_dir, "file_names").select("page_id", files.size_mb(F.col("length")).alias("size_mb"))


@query("categorise", f"SELECT path, ext, category FROM {WANTS}")
def categorise(spark, sf_dir):
    name = files.name_of(F.col("path"))
    df = derived(spark, sf_dir, "file_names").select("path", files.suffix_of(name).alias("ext"))
    return files.categorise(df)


# Beginnings that tell a type, written before the text of pages.
MARKED = "CASE file % 4 WHEN 0 THEN '%PDF-1.4 ' WHEN 1 THEN 'GIF89a ' WHEN 2 THEN '{\\rtf1 ' ELSE '' END"


@query(
    "detect_type",
    """SELECT DISTINCT page_id % 40 AS file, CASE page_id % 4 WHEN 0 THEN 'application/pdf (pdf)'
        WHEN 1 THEN 'image/gif (gif)' WHEN 2 THEN 'application/rtf (rtf)' ELSE 'unknown' END AS detected FROM pages""",
)
def detect_type(spark, sf_dir):
    root = scratch_path(spark, "types")
    pages = table(spark, sf_dir, "pages").selectExpr("page_id % 40 AS file", "page_id AS line_id", "url")
    write_text_tree(pages.withColumn("line", F.concat(F.expr(MARKED.replace("\\", "\\\\")), F.lit("x "), "url")), root)
    heads = read_heads(list_files(spark, root).select("path").filter("path LIKE '%.txt' AND path NOT LIKE '%/.%'"))
    return heads.select(file_number(F.col("path")).alias("file"), inventory.detection(F.col("head")).alias("detected"))


@query("file_link", f"SELECT path, 'file:///' || replace(path, ' ', '%20') AS link FROM {WANTS}")
def file_link(spark, sf_dir):
    return derived(spark, sf_dir, "file_names").select("path", files.file_link(F.col("path")).alias("link"))


def _records(spark, sf_dir):
    return inventory.file_records(derived(spark, sf_dir, "file_names"))


def _parts(spark, sf_dir):
    return parts.category_parts(_records(spark, sf_dir), LIMIT)


PARTS = f"""(SELECT path, category, size_mb, part,
    substr(CASE WHEN n <= {LIMIT} THEN category ELSE category || '_part' || part END, 1, 31) AS title FROM
    (SELECT path, category, {SIZE} AS size_mb, count(*) OVER (PARTITION BY category) AS n,
        (row_number() OVER (PARTITION BY category ORDER BY path) - 1) // {LIMIT} + 1 AS part FROM {WANTS}))"""


@query("category_parts", f"SELECT path, category, part, title FROM {PARTS}")
def category_parts(spark, sf_dir):
    return _parts(spark, sf_dir).select("path", "category", "part", "title")


@query(
    "category_summary",
    f"""SELECT category, part, title, count(*) AS files, CAST(sum(size_mb) AS DOUBLE) AS size_mb
        FROM {PARTS} GROUP BY ALL""",
)
def category_summary(spark, sf_dir):
    return parts.category_summary(_parts(spark, sf_dir))


@query(
    "category_rollup",
    f"""SELECT coalesce(title, '{TOTAL_LABEL}') AS "{SUMMARY_COLUMNS[0]}", count(*) AS "{SUMMARY_COLUMNS[1]}",
        CAST(sum(size_mb) AS DOUBLE) AS "{SUMMARY_COLUMNS[2]}" FROM {PARTS} GROUP BY ROLLUP (title)""",
)
def category_rollup(spark, sf_dir):
    return parts.category_rollup(_parts(spark, sf_dir))


TITLES = dict(INVENTORY_COLUMNS)


@query(
    "inventory_export",
    f"""SELECT folder AS "{TITLES['folder']}", name AS "{TITLES['name']}", ext AS "{TITLES['ext']}",
        CAST(NULL AS VARCHAR) AS "{TITLES['created']}",
        strftime(TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' SECOND, '%Y-%m-%d %H:%M:%S')
            AS "{TITLES['modified']}",
        CAST({SIZE} AS DOUBLE) AS "{TITLES['size_mb']}", 'unknown' AS "{TITLES['detected']}",
        path AS "{TITLES['path']}", category AS "{TITLES['category']}" FROM {WANTS}""",
)
def inventory_export(spark, sf_dir):
    return sinks.inventory_export(_records(spark, sf_dir))


TIME, ACTION, FILE, NOTE = AUDIT_COLUMNS


@query(
    "audit_rows",
    f"""SELECT '{SCAN_OK}' AS "{ACTION}", path AS "{FILE}", category AS "{NOTE}" FROM {WANTS}""",
)
def audit_rows(spark, sf_dir):
    listing = derived(spark, sf_dir, "file_names").withColumns({"status": F.lit("ok"), "note": F.lit("")})
    return inventory.audit_rows(listing, inventory.file_records(listing)).drop(TIME)


@query(
    "event_time_text",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events",
)
def event_time_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.time_text(F.col("ts")).alias("time"))
